"""Substring deduplication over a log-structured fingerprint index.

A window is `WINDOW` consecutive words of one document. Its hash is the least of the hashes of the shorter word runs in
it, so neighbouring windows mostly share theirs, and equal windows always do, at the same offset. Windows of a document
that share the hash and the place it comes from are one entry: (hash, digest of all the words that they cover).

The index holds entries, per block of documents, in immutable runs sorted and bucketed by hash. Each new batch is written
as a run and merge-joined with the earlier runs, without a shuffle: hashes found twice are candidates, in the new batch
and in history. Where all entries of a hash have one digest they repeat as a whole; others are verified window by window,
by 128-bit digests of the words. Runs are compacted by tiers: `TIER` runs of like size become one, and the old ones are
deleted, so an entry is rewritten once a tier and there are few runs however many batches came.

An index lives under a path that a later session can open: a manifest, whose newest version counts, lists its runs, and for
`Corpus` the blocks of documents themselves, what was found of them, and where numbers of new blocks begin. A `Corpus` is
deduplicated batch by batch: only new blocks and those earlier ones that hold a hash of the new batch are read, and
it gives the new documents and the earlier ones whose text is another now, as one pass over all would.

Every occurrence of a repeated window loses its words, the first too, within a document as across documents; windows are
judged on the input. Rows: a null text has no words and stays null; fewer than WINDOW words are never removed; rows that
repeat are documents of their own and so remove each other's windows; an empty table gives no rows. Columns other than
the text pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, buffer_of, grouped, run_hashes, span_hashes, word_spans
from .blocks import SCHEMA, answered, bucketed, bucketed_at, unpacked, write_blocks
from .common import dropped, listed, partitions, scratch, shuffles_released, stored

WINDOW, TIER, BATCHES = 35, 4, 4
PLACE = U((1 << 26) - 1)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, and how often it occurs."""
    at, group = grouped(a)
    if (b[at][group] != b).any():  # equal in one half only
        order = np.lexsort((b, a))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        at, group = order[new], np.cumsum(new) - 1
    return at, np.bincount(group, minlength=len(at))


class Windows:
    """Word hashes, windows and entries of the texts of a block."""

    def __init__(self, texts: pa.Array, width: int):
        self.width = width
        self.buf, offsets = buffer_of(texts)
        self.starts, self.ends, self.doc = word_spans(self.buf, offsets)
        self.h = span_hashes(self.buf, self.starts, self.ends)
        gram = max(1, width // 3)
        span, n = width - gram + 1, len(self.h) - width + 1
        if n <= 0 or not (valid := self.doc[: max(n, 0)] == self.doc[width - 1 :]).any():
            self.fp = self.digest = np.zeros(0, U)
            self.first = self.last = np.zeros(0, np.int64)
            return
        grams = run_hashes(self.h, np.arange(len(self.h) - gram + 1), np.full(len(self.h) - gram + 1, gram), 0)
        least = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: n], least[span - reach : span - reach + n])
        anchor = (least[:n] & PLACE).astype(np.int64)
        windows = np.flatnonzero(valid)
        anchor = anchor[windows]
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.last = windows[at], windows[np.append(at[1:], len(windows)) - 1]
        self.fp = grams[anchor[at]]
        self.digest = run_hashes(self.h, self.first, self.last - self.first + width, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, digest and how often, each pair once."""
        at, n = _pairs(self.fp, self.digest)
        return self.fp[at], self.digest[at], n

    def windows_of(self, hashes: np.ndarray) -> np.ndarray:
        """The windows of the entries with these hashes."""
        some = np.isin(self.fp, hashes)
        first, n = self.first[some], (self.last - self.first + 1)[some]
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def digests(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        widths = np.full(len(windows), self.width)
        return run_hashes(self.h, windows, widths, 1), run_hashes(self.h, windows, widths, 2)

    def removed(self, whole: np.ndarray, mixed: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which words go: all that entries with hashes `whole` cover, and those windows of `mixed` hashes with digests one, two."""
        edges = np.zeros(len(self.h) + 1, dtype=np.int64)
        some = np.isin(self.fp, whole)
        np.add.at(edges, self.first[some], 1)
        np.add.at(edges, self.last[some] + self.width, -1)
        if len(one):
            windows = self.windows_of(mixed)
            a, b = self.digests(windows)
            windows = windows[np.isin(a, one) & np.isin(b, two)]
            np.add.at(edges, windows, 1)
            np.add.at(edges, windows + self.width, -1)
        return np.cumsum(edges[:-1]) > 0


class FingerprintIndex:
    """Runs of (fp, d, block, n), sorted and bucketed by fp; a batch is a table of blocks whose numbers no other batch has. With the path of an earlier index, goes on from its newest manifest."""

    ENTRY = "fp long, d long, block long, n int"

    def __init__(self, spark: SparkSession, text: str = "text", width: int = WINDOW, path: str | None = None):
        self.spark, self.text, self.width = spark, text, width
        self.path = path or scratch(spark, "index")
        self.buckets, self.version = partitions(spark), 0
        self.runs: list[tuple[str, int, DataFrame]] = []  # folder, how many rows, rows
        self.more: dict = {}  # what else the manifest holds
        known = [int(n) for n in listed(spark, f"{self.path}/manifest") if n.isdigit()] if path else []
        if known:
            self.version = max(known)
            saved = json.loads(spark.read.text(f"{self.path}/manifest/{self.version}").first()[0])
            if saved["width"] != width:
                raise ValueError(f"the index holds windows of {saved['width']} words")
            self.buckets, self.more = saved["buckets"], saved["more"]
            self.runs = [(r, n, bucketed_at(spark, "run", f"{self.path}/{r}", self.ENTRY, "fp", self.buckets)) for r, n in saved["runs"]]

    def _write(self, rows: DataFrame) -> tuple[str, int, DataFrame]:
        folder = f"run-{uuid.uuid4().hex[:12]}"
        run = bucketed(rows.repartition(self.buckets, "fp"), "run", "fp", self.buckets, sorted_=True, path=f"{self.path}/{folder}")
        return folder, run.count(), run

    def commit(self) -> None:
        """Makes the index as it is now what a later session finds."""
        self.version += 1
        line = json.dumps({"width": self.width, "buckets": self.buckets, "runs": [(r, n) for r, n, _ in self.runs], "more": self.more})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the batch; gives block, fp, mixed of the candidates that it has made, in itself and in earlier batches. It lasts once commit() is called."""
        text, width = self.text, self.width

        def run(batches):
            for b in batches:
                for number, payload in zip(b.column(0), b.column(1)):
                    w = Windows(unpacked(payload.as_py()).column(text).combine_chunks(), width)
                    fp, d, n = w.entries()
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(d.view(np.int64)), pa.array(np.full(len(fp), number.as_py())), pa.array(n.astype(np.int32))], names=["fp", "d", "block", "n"])

        written = self._write(batch.select("block", "payload").mapInArrow(run, self.ENTRY))
        new, earlier = written[2], [rows for *_, rows in self.runs]
        found = self._keys(new)
        for k, old in enumerate(earlier):
            other = self._keys(old).toDF("fp", f"n{k}", f"low{k}", f"high{k}")
            found = found.join(other.hint("merge"), "fp", "left")
            found = found.select("fp", (F.col("n") + F.coalesce(f"n{k}", F.lit(0))).alias("n"), F.least("low", f"low{k}").alias("low"), F.greatest("high", f"high{k}").alias("high"))
        found = found.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("mixed"))
        if earlier:  # looked up in each run: made once, and laid out like the runs
            found = bucketed(found, "found", "fp", self.buckets, sorted_=True)
        hits = [run_.join(found.hint("merge"), "fp").select("block", "fp", "mixed") for run_ in [new, *earlier]]
        out = hits[0]
        for h in hits[1:]:
            out = out.unionByName(h)
        out = stored(out.distinct(), "candidates")
        self.runs.append(written)
        return out

    @staticmethod
    def _keys(run: DataFrame) -> DataFrame:
        return run.groupBy("fp").agg(F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))

    def compact(self, most: int = TIER) -> None:
        """Merges the newest runs while `most` of them are of like size (within a factor of 2; or whatever their sizes, once there are 4 TIER runs), and deletes them when the manifest no longer names them."""
        gone: list[str] = []
        while len(self.runs) >= most:
            some = self.runs[-most:]
            sizes = [max(n, 1) for _, n, _ in some]
            if max(sizes) > 2 * min(sizes) and len(self.runs) < 4 * TIER:
                break
            rows = some[0][2]
            for *_, r in some[1:]:
                rows = rows.unionByName(r)
            self.runs[-most:] = [self._write(rows)]
            gone += [folder for folder, *_ in some]
        self.commit()
        for folder in gone:
            dropped(self.spark, f"{self.path}/{folder}")


def verified(blocks: DataFrame, candidates: DataFrame, text: str, width: int) -> DataFrame:
    """block, kind, a, b: hashes that repeat as a whole (kind 0: a), hashes to look at by window (1: a), and digests of windows that repeat (2: a, b). candidates: block, fp, mixed, each pair once, and their blocks."""

    def ask(block: int, payload: bytes, hits: pa.Table) -> pa.Table:
        one = two = np.zeros(0, U)
        n = np.zeros(0, np.int64)
        if hits.num_rows:
            w = Windows(unpacked(payload).column(text).combine_chunks(), width)
            windows = w.windows_of(np.asarray(hits["fp"]).view(U))
            a, b = w.digests(windows)
            at, n = _pairs(a, b)
            one, two = a[at], b[at]
        return pa.table([pa.array(np.full(len(one), block)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n)], names=["block", "a", "b", "n"])

    # a window has one row for each block that holds it, however often it does; those of a window in very many blocks are summed before they move, and a join can split them
    asked = stored(answered(blocks, candidates.where("mixed").select("block", "fp"), ask, "block long, a long, b long, n long"), "windows")
    again = asked.groupBy("a", "b").agg(F.sum("n").alias("m")).where("m > 1").select("a", "b")
    windows = asked.join(again.hint("merge"), ["a", "b"]).select("block", F.lit(2).alias("kind"), "a", "b")
    hashes = candidates.select("block", F.col("mixed").cast("int").alias("kind"), F.col("fp").alias("a"), F.lit(0).cast("long").alias("b"))
    return hashes.unionByName(windows)


def repeated(blocks: DataFrame, text: str, width: int, batches: int) -> DataFrame:
    """What verified() says of all blocks, added to an index batch by batch."""
    index = FingerprintIndex(blocks.sparkSession, text, width)
    candidates = None
    for k in range(batches):
        found = index.add(blocks.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == k))
        candidates = found if candidates is None else candidates.unionByName(found)
        index.compact()
        shuffles_released(blocks.sparkSession)
    # a hash that is mixed in any batch is looked at by window
    candidates = stored(candidates.groupBy("block", "fp").agg(F.max("mixed").alias("mixed")), "candidates")
    dropped(blocks.sparkSession, index.path)  # nothing is added to this one
    return verified(blocks, candidates, text, width)


def _finish(make: Callable[[pa.Table, Windows, np.ndarray], pa.Table], text: str, width: int):
    def finish(block: int, payload: bytes, flags: pa.Table) -> pa.Table:
        rows = unpacked(payload)
        w = Windows(rows.column(text).combine_chunks(), width)
        kind, a, b = (np.asarray(flags[c]) for c in ("kind", "a", "b"))
        a, b = a.view(U), b.view(U)
        return make(rows, w, w.removed(a[kind == 0], a[kind == 1], a[kind == 2], b[kind == 2]))

    return finish


def judged(docs: DataFrame, text: str, make: Callable[[pa.Table, Windows, np.ndarray], pa.Table], schema, width: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """make(rows of a block, their windows, which words go) for each block."""
    blocks = write_blocks(docs, text)
    return answered(blocks, repeated(blocks, text, width, batches), _finish(make, text, width), schema)


def _cut_out(text: str, n_chars: str | None):
    """Rows with the words that go cut out of their texts."""

    def make(rows: pa.Table, w: Windows, gone: np.ndarray) -> pa.Table:
        old = rows.column(text).to_pylist()
        for d in np.unique(w.doc[gone]):
            mine = np.flatnonzero(w.doc == d) if len(old) == 1 else np.arange(*np.searchsorted(w.doc, [d, d + 1]))
            cut, parts, at = gone[mine], [], None
            base, end = int(w.starts[mine[0]]), int(w.ends[mine[-1]])
            raw = old[d].encode()
            lead = len(raw) - len(raw.lstrip(b" \t\n\v\f\r"))
            shift = lead - base
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
            at = 0
            for a, b in zip(edges[::2], edges[1::2]):
                parts.append(raw[at : int(w.starts[mine[a]]) + shift])
                at = int(w.ends[mine[b - 1]]) + shift
            parts.append(raw[at:])
            old[d] = b"".join(parts).decode()
        out = rows.set_column(rows.schema.get_field_index(text), rows.schema.field(text), pa.array(old, rows.schema.field(text).type))
        if n_chars:
            lengths = pa.array([None if x is None else len(x) for x in old], pa.int64())
            i = out.schema.get_field_index(n_chars)
            out = out.set_column(i, out.schema.field(n_chars), lengths.cast(out.schema.field(n_chars).type))
        return out

    return make


def deduplicated(docs: DataFrame, text: str = "text", width: int = WINDOW, n_chars: str | None = None) -> DataFrame:
    """docs with the words of repeated windows cut out of the text; texts without any stay byte for byte. n_chars: a column to set to the new length."""
    return judged(docs, text, _cut_out(text, n_chars), docs.schema, width)


class Corpus:
    """Documents deduplicated batch by batch, in one session or many: under its path lie the index, the blocks of all documents and what was found of them."""

    FLAGS = "block long, kind int, a long, b long"

    def __init__(self, spark: SparkSession, path: str, text: str = "text", width: int = WINDOW, n_chars: str | None = None):
        self.spark, self.text, self.width, self.n_chars = spark, text, width, n_chars
        self.index = FingerprintIndex(spark, text, width, path)

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = self.index.more.get(kind, [])
        out = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.index.path}/{f}" for f in folders]) if folders else out

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The new documents without repeated words, and the earlier documents of blocks that share a hash with them, as they are now. All batches have the same columns."""
        index, more = self.index, self.index.more
        columns = docs.schema.json()
        if more.setdefault("schema", columns) != columns:
            raise ValueError("a batch has the columns of those before it")
        folders = {kind: f"{kind}-{uuid.uuid4().hex[:12]}" for kind in ("blocks", "flags")}
        earlier = self._read("blocks", SCHEMA)
        blocks = write_blocks(docs, self.text, first_part=more.get("parts", 0), path=f"{index.path}/{folders['blocks']}")
        last = blocks.agg(F.max("part")).first()[0]
        candidates = index.add(blocks)
        hit = stored(candidates.select("block").distinct(), "hit")
        old = earlier.join(hit, "block", "left_semi")
        both = blocks.unionByName(old.select(*blocks.columns))
        verified(both.join(hit, "block", "left_semi"), candidates, self.text, self.width).write.parquet(f"{index.path}/{folders['flags']}")
        for kind, folder in folders.items():
            more.setdefault(kind, []).append(folder)
        more["parts"] = more.get("parts", 0) if last is None else last + 1
        index.compact()
        flags = self._read("flags", self.FLAGS)
        finish = _finish(_cut_out(self.text, self.n_chars), self.text, self.width)
        return answered(blocks, flags.join(blocks.select("block"), "block", "left_semi"), finish, docs.schema), answered(old, flags.join(old.select("block"), "block", "left_semi"), finish, docs.schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(rows: pa.Table, w: Windows, gone: np.ndarray) -> pa.Table:
        n = rows.num_rows
        cuts = np.searchsorted(w.doc, np.arange(n + 1))
        raw = w.buf.tobytes()
        digests = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            words = raw[w.starts[a] : w.ends[b - 1]].split() if b > a else []
            if gone[a:b].any():
                words = [x for x, g in zip(words, gone[a:b]) if not g]
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        removed = np.bincount(w.doc[gone], minlength=n)
        return pa.table([rows.column("doc_id"), pa.array(np.diff(cuts)), pa.array(removed.astype(np.int64)), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return judged(docs, "text", make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p
), r AS (
  SELECT doc_id, unnest(range(i, i + 35)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1
), g AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM r GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
