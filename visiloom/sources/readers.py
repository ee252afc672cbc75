"""Scans: JSON lines (strict and lenient), benchmark files, Parquet with file order, CSV, text and file fingerprints."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.checks import IntegrityError, required


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has files, on whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1 in its file), place (from 0 over all files by name) and value of every line, blank ones too.

    A file is read in splits, by many tasks. A line's place in its split comes from its id within the task; the splits, one
    row each, are counted and summed up, so no text is moved and none goes through Python. Lines end at \\n, \\r\\n or \\r."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_"), "value").withColumn("id_", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split_", "first_", before(Window.partitionBy("file").orderBy("split_")).alias("in_file_"), before(Window.orderBy("file", "split_")).alias("in_all_"))
    at = F.col("id_") - F.col("first_")
    return rows.join(splits, ["file", "split_"]).select("file", (F.col("in_file_") + at + 1).alias("line"), (F.col("in_all_") + at).alias("place"), "value")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped. strict: a line that isn't an object of these types raises, with its file, number and text."""
    if strict:
        bad = rejects(spark, path, schema).orderBy("file", "line").limit(1).collect()
        if bad:
            raise IntegrityError(f"{bad[0].file}:{bad[0].line}: not an object of these types: {bad[0].text[:200]}")
    return spark.read.schema(schema).json(path, mode="PERMISSIVE" if strict else "DROPMALFORMED")


def rejects(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """file, line (from 1) and text of what read_jsonl can't read."""
    held = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = read_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("x", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("x").isNull() | F.col("x._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(bad).select("file", "line", F.col("value").alias("text"))


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_jsonl(spark, path, schema, strict=False) if exists(spark, path) else spark.createDataFrame([], schema)


def read_shards(spark: SparkSession, patterns: str | list[str], schema: T.StructType, recursive: bool = False) -> DataFrame:
    """The union of shard files, with the file that each row is from."""
    read = spark.read.schema(schema).option("recursiveFileLookup", recursive)
    return read.json(patterns).withColumn("source_file", F.col("_metadata.file_path"))


def read_roots(spark: SparkSession, roots: dict[str, str], schema: T.StructType) -> DataFrame:
    """The union of several roots with the root's name as provenance."""
    out = None
    for name, path in roots.items():
        df = read_jsonl(spark, path, schema, strict=False).withColumn("provenance", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no roots")
    return out


BENCHMARK_LINE = "query string, sources array<struct<cleaned_text:string,raw_text:string>>, sugg_idx int, tags array<string>"


def read_benchmark(spark: SparkSession, path: str, field: str = "cleaned_text", limit: int | None = None, benchmark: str = "geo_bench") -> DataFrame:
    """Instances of a JSON-lines benchmark; an instance's id is its line number from 0, over all files by name."""
    numbered = read_lines(spark, path).where(F.trim("value") != "").withColumn("line", F.col("place"))
    x = F.from_json("value", BENCHMARK_LINE)
    df = numbered.select("line", x.alias("x"))
    out = df.select(F.lit(benchmark).alias("benchmark"), F.lit("all").alias("domain"), F.col("line").cast("string").alias("instance_id"), "x.query", F.transform("x.sources", lambda s: s[field]).alias("documents"), F.col("x.sugg_idx").alias("target_document_index"), "x.tags", "line")
    return (out.orderBy("line").limit(limit) if limit is not None else out).drop("line")


def read_domain_parquet(spark: SparkSession, pattern: str, columns: tuple[str, ...] = ("query_id", "query", "document")) -> DataFrame:
    """The named columns of files called <domain>_*.parquet, with the domain and each row's place in its file."""
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    name = F.col("_metadata.file_name")
    return spark.read.parquet(pattern).select(*columns, F.regexp_extract(name, r"^([^_.]+)", 1).alias("domain"), name.alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON document, on any store."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_catalog(spark: SparkSession, root: str, entries: Iterable[dict], id_field: str = "prompt_id", file_field: str = "file") -> DataFrame:
    """id, text of a prompt catalog's entries; duplicate ids, paths that leave the root and missing files raise."""
    entries = list(entries)
    ids = [e[id_field] for e in entries]
    if len(set(ids)) != len(ids):
        raise IntegrityError("catalog ids repeat")
    for e in entries:
        if e[file_field].startswith("/") or ".." in e[file_field].split("/"):
            raise IntegrityError(f"{e[file_field]} leaves the catalog")
    listed = spark.createDataFrame([(e[id_field], e[file_field]) for e in entries], f"{id_field} string, name string")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    j = listed.join(files, F.expr("endswith(path, concat('/', name))"), "left")
    required(j.where("text is null").select(id_field), "catalog files are missing")
    return j.select(id_field, "text")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """digest, name of a checksum list; a name twice raises."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    df = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("digest"), F.regexp_replace(parts[1], r"^\*?(\./)?", "").alias("name"))
    required(df.groupBy("name").count().where("count > 1"), "checksum list has a name twice")
    return df


def fingerprints(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """name (below root), sha256, size of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    name = F.replace(F.col("p"), F.lit(root.rstrip("/") + "/"), F.lit("")) if root else F.col("p")
    return files.select(at.alias("p"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).select(name.alias("name"), "sha256", "size")


def checksum_defects(listed: DataFrame, found: DataFrame) -> DataFrame:
    """name, problem: missing, unlisted or changed."""
    j = listed.join(found, "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.col("digest") != F.col("sha256"), "changed")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def read_texts(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """path, text of all text files below a root."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class LazyTexts:
    """Versioned prompt texts, read when first asked for. An unknown version is a KeyError, one without a file a FileNotFoundError."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths, self.read = spark, dict(paths), {}

    def __getitem__(self, version: str) -> str:
        path = self.paths[version]
        if version not in self.read:
            if not exists(self.spark, path):
                raise FileNotFoundError(f"{version}: {path}")
            self.read[version] = self.spark.read.text(path, wholetext=True).first()[0]
        return self.read[version]

    def __iter__(self):
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)

    def __contains__(self, version: object) -> bool:
        return version in self.paths
