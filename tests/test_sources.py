import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from visiloom.functions.keys import SCHEMAS
from visiloom.operators.checks import IntegrityError
from visiloom.sources import readers, sinks


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"sample_id": "s", "seed": 1}\n\n{"sample_id": "t", "seed": 2}\n')
    schema = "sample_id string, seed int"
    from pyspark.sql.types import _parse_datatype_string as parse

    assert readers.read_jsonl(spark, str(p), parse(schema)).count() == 2
    p.write_text('{"sample_id": "s"}\n[1]\nnot json\n')
    assert readers.rejects(spark, str(p), parse(schema)).count() == 2
    with pytest.raises(IntegrityError, match="a.jsonl"):
        readers.read_jsonl(spark, str(p), parse(schema))
    assert readers.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), parse(schema)).count() == 0


def test_benchmark_and_domains(spark, tmp_path):
    p = tmp_path / "geo.jsonl"
    p.write_text("".join(json.dumps({"query": f"q{i}", "sources": [{"cleaned_text": f"c{i}", "raw_text": f"r{i}"}], "sugg_idx": 0, "tags": ["t"]}) + "\n" for i in range(3)))
    rows = readers.read_benchmark(spark, str(p), "raw_text", 2).collect()
    assert [(r.instance_id, r.documents) for r in rows] == [("0", ["r0"]), ("1", ["r1"])]
    spark.createDataFrame([(1, "q", "d1"), (1, "q", "d2")], "query_id int, query string, document string").coalesce(1).toPandas().to_parquet(tmp_path / "news_0.parquet")
    got = readers.read_domain_parquet(spark, str(tmp_path / "*.parquet")).orderBy("row_index").collect()
    assert [(r.domain, r.row_index, r.document) for r in got] == [("news", 0, "d1"), ("news", 1, "d2")]
    with pytest.raises(FileNotFoundError):
        readers.read_domain_parquet(spark, str(tmp_path / "x*.parquet"))


def test_catalog_and_checksums(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("alpha")
    (tmp_path / "c/b.txt").write_text("beta")
    got = readers.read_catalog(spark, str(tmp_path / "c"), [{"prompt_id": "a", "file": "a.txt"}]).collect()
    assert [(r.prompt_id, r.text) for r in got] == [("a", "alpha")]
    for bad in ([{"prompt_id": "a", "file": "../a.txt"}], [{"prompt_id": "a", "file": "z.txt"}], [{"prompt_id": "a", "file": "a.txt"}] * 2):
        with pytest.raises(IntegrityError):
            readers.read_catalog(spark, str(tmp_path / "c"), bad)
    digest = hashlib.sha256(b"alpha").hexdigest()
    (tmp_path / "sums").write_text(f"{digest}  a.txt\n{'0' * 64}  gone.txt\n")
    found = readers.fingerprints(spark, str(tmp_path / "c"), str(tmp_path / "c"))
    got = {r.name: r.problem for r in readers.checksum_defects(readers.read_checksums(spark, str(tmp_path / "sums")), found).collect()}
    assert got == {"gone.txt": "missing", "b.txt": "unlisted"}
    lazy = readers.LazyTexts(spark, {"v1": str(tmp_path / "c/a.txt"), "v2": str(tmp_path / "none.txt")})
    assert lazy["v1"] == "alpha" and "v2" in lazy and len(lazy) == 2
    with pytest.raises(FileNotFoundError):
        lazy["v2"]
    with pytest.raises(KeyError):
        lazy["v3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1.0), (1, "a", None)], "k int, s string, v double")
    sinks.write_jsonl(df, str(tmp_path / "j"), ["k"], single_file=True)
    assert [json.loads(x)["k"] for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text().splitlines()] == [1, 2]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_jsonl(df, str(tmp_path / "j"), ["k"])
    sinks.write_csv(df.orderBy("k"), str(tmp_path / "c"), ["k", "v", "none"])
    assert next((tmp_path / "c").glob("part*")).read_text().splitlines()[0] == "k,v,none"
    sinks.write_document(df.agg(F.count("*").alias("n")), str(tmp_path / "d"))
    assert json.loads("\n".join(p.read_text() for p in (tmp_path / "d").glob("part*"))) == {"n": 2}
    sinks.write_split(df, str(tmp_path / "s"), "s")
    assert (tmp_path / "s/s=a").exists()
    sinks.write_views(df, {"one": (str(tmp_path / "v1"), "k = 1"), "all": (str(tmp_path / "v2"), "true")})
    assert spark.read.json(str(tmp_path / "v1")).count() == 1
    with pytest.raises(ValueError):
        sinks.distinct_paths("a", "a/")
    assert sinks.heat_color(1.0, 1.0) == "#00ff00" and sinks.heat_color(-1.0, 1.0) == "#ff0000" and sinks.heat_color(None, 1.0) == "#ffffff"
    wide = sinks.heat_table(df, "s", "k", "v")
    assert "<td style=\"background:#00ff00\">1.0000" in sinks.heat_html(wide, "s", "t")
    assert sinks.markdown_table(df.orderBy("k")).splitlines()[2] == "| 1 | a |  |"


def test_schemas_are_named(spark):
    assert spark.createDataFrame([], SCHEMAS["judge_trial"]).columns[:6] == ["model", "sample_id", "prompt_id", "answer_seed", "dimension", "judge_seed"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files that are read in many splits: line ends of all kinds, blank lines, no end at the end; bad lines by file and number."""
    from pyspark.sql import types as T

    k_int = T.StructType([T.StructField("k", T.IntegerType())])
    rng = random.Random(2)
    files = {}
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        lines = [rng.choice(["", '{"k": %d, "t": "%s"}' % (i, "é" * rng.randint(0, 30))]) for i in range(200)]
        files[name] = lines
        (tmp_path / name).write_bytes("".join(x + rng.choice(["\n", "\r\n"]) for x in lines).encode().removesuffix(b"\n").removesuffix(b"\r"))
    (tmp_path / "d.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = readers.read_lines(spark, str(tmp_path))
        got = df.orderBy("place").collect()
        assert df.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        want = [(n, i, x) for n in sorted(files) for i, x in enumerate(files[n], 1)]
        while want[-1][2] == "" and len(want) > len(got):
            want.pop()
        assert [r.place for r in got] == list(range(len(got)))
        plain = [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in got]
        blank = [w for w in want if w not in plain]
        assert all(not x for *_, x in blank) and len(blank) <= 3  # a blank last line without an end is none
        (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": "x"}\n[1]\n')
        bad = readers.rejects(spark, str(tmp_path / "a.jsonl"), k_int).orderBy("line").collect()
        assert [(r.line, r.text) for r in bad] == [(3, '{"k": "x"}'), (4, "[1]")]
        with pytest.raises(IntegrityError, match=r"a\.jsonl:3: "):
            readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), k_int)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
