"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the words that it holds; the document's score is
their noisy-or, 1 - prod(1 - p). Only documents have labels: the weights are fitted through the noisy-or, so the sentences
that carry a label are found, not given, and `sentences` locates them.

Words count by themselves and by their beginnings (`PREFIXES`, in bytes), so inflected forms of a stem count together.
The fit uses at most `SAMPLE` labelled documents (those of lowest id hash, a parameter), and of their words and beginnings
the `FEATURES` most associated with the label; scoring covers every row and whole texts. Labels, language, source and id never
enter a score.

Rows: a null or empty text has no sentence and gets the bag's floor, the score of one sentence without words. Rows that
repeat a doc_id are scored each by its own text; a null doc_id is in the held-out part. Without a toxic label all
scores are next to 0; with no other label, next to 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, buffer_of, mix, pack, release, span_hashes, unpack
from .common import clear_of, held_out, slices, small_batches, stored

BUCKETS = 1 << 20
SAMPLE, FEATURES, ROUNDS = 8000, 3000, 200
PREFIXES = (5, 6, 7, 8, 9, 10, 12)
PIECE = 1 << 18
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = IN_WORD[39] = True
BREAK = np.zeros(256, dtype=bool)
BREAK[[10, 33, 46, 63]] = True  # newline ! . ?


@dataclass
class Model:
    buckets: np.ndarray  # of the words that count
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word and beginning of a word: bucket and sentence; of each sentence with words: text, first and last byte; and the bytes."""
    raw, offsets = buffer_of(texts)
    buf = LOWER[raw]
    inside = IN_WORD[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = np.cumsum(BREAK[buf])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    whole, *begins = span_hashes(buf, starts, ends, *PREFIXES)
    salted = [whole, *(mix(h + np.uint64(n)) for n, h in zip(PREFIXES, begins))]
    longer = [np.ones(len(starts), dtype=bool), *(ends - starts > n for n in PREFIXES)]
    bucket = np.concatenate([h[m] for h, m in zip(salted, longer)]) & np.uint64(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate([sentence[m] for m in longer]), doc[first], starts[first], ends[last], raw


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str, text: str) -> DataFrame:
    """y, t of at most `most` labelled documents outside the held-out fifth."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out("i", 5)).groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(known), "i").select("y", "t")
    return stored(rows.limit(4 * most), "labelled")  # rows that repeat an id are bounded too


def _chosen(sample: DataFrame, n: int, positive: int) -> np.ndarray:
    """The buckets most associated with the label, over documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, marked = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for piece in slices(batch, 1, PIECE):
                y = np.asarray(piece.column(0)) > 0
                bucket, sentence, of, *_ = words_of(piece.column(1))
                pair = np.unique(of[sentence] * BUCKETS + bucket)
                np.add.at(has, pair % BUCKETS, 1)
                np.add.at(marked, pair[y[pair // BUCKETS]] % BUCKETS, 1)
        some = np.flatnonzero(has)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(has[some].astype(np.int64)), pa.array(marked[some].astype(np.int64))], names=["b", "has", "marked"])
        release()

    sums = sample.mapInArrow(run, "b long, has long, marked long").groupBy("b").agg(F.sum("has").alias("has"), F.sum("marked").alias("marked")).where("has >= 3")
    rate = positive / n
    chi = F.pow(F.col("marked") - F.col("has") * rate, 2) / (F.col("has") * rate * (1 - rate))
    return np.sort(np.array([r.b for r in sums.orderBy(chi.desc(), "b").limit(FEATURES).collect()], dtype=np.int64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits the sentence weights to document labels by gradient steps (Adam) through the noisy-or."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, label, most, doc_id, text)
    count, positive = sample.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    if not positive or positive == count:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0 if not positive else float(np.log(2 * count + 1)))
    chosen = _chosen(sample, count, positive)
    n = len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1)
        place[chosen] = np.arange(n)
        for batch in batches:
            for piece in slices(batch, 1, PIECE):
                bucket, sentence, of, *_ = words_of(piece.column(1))
                f = place[bucket]
                pair = np.unique(sentence[f >= 0] * n + f[f >= 0])
                cuts = np.searchsorted(of, np.arange(piece.num_rows + 1))  # sentences of each text
                at = np.searchsorted(pair, cuts * n)
                blobs = [pack(pair[a:b] - c * n) for a, b, c in zip(at[:-1], at[1:], cuts[:-1])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(cuts)), pa.array(blobs, pa.binary())], names=["y", "sentences", "words"])

    # at most 4 * most rows, of the chosen words only; the order decides how sums round
    rows = sorted(sample.mapInArrow(run, "y int, sentences long, words binary").collect(), key=lambda r: (r.y, bytes(r.words)))
    y = np.array([r.y > 0 for r in rows], dtype=np.float64)
    held = np.array([r.sentences for r in rows], dtype=np.int64)
    of_sentence = np.repeat(np.arange(len(rows)), held)
    keys = [unpack(r.words).astype(np.int64) for r in rows]
    flat = np.concatenate(keys) + np.repeat((np.cumsum(held) - held) * n, [len(k) for k in keys])
    f, s, m = flat % n, flat // n, len(of_sentence)
    theta = np.zeros(n + 1)
    theta[n] = -6.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, ROUNDS + 1):
        z = np.clip(np.bincount(s, weights=theta[f], minlength=m) + theta[n], -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(of_sentence, weights=np.log1p(np.exp(z)), minlength=len(y)), 1e-12)
        back = np.where(y > 0, -np.exp(-total) / -np.expm1(-total), 1.0) / len(y)
        g = back[of_sentence] * p
        gradient = np.append(np.bincount(f, weights=g[s], minlength=n), g.sum())
        gradient[:n] += 1e-5 * theta[:n]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(chosen, theta[:n].astype(np.float32), float(theta[n]))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str, str] = ("score", "n_offending", "worst_sentence")) -> DataFrame:
    """The kept columns, the score, how many sentences have at least 0.5 on their own, and the worst of these (else null)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    out = kept.schema.add(names[0], "double").add(names[1], "long").add(names[2], "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense().astype(np.float64)
        for batch in batches:
            for piece in slices(batch, len(keep), PIECE):
                bucket, sentence, of, a, b, raw = words_of(piece.column(len(keep)))
                some = weights[bucket] != 0
                pair = np.unique(sentence[some] * BUCKETS + bucket[some])  # a word counts once a sentence
                z = np.clip(np.bincount(pair // BUCKETS, weights=weights[pair % BUCKETS], minlength=len(of)) + model.bias, -30, 30)
                total = np.bincount(of, weights=np.log1p(np.exp(z)), minlength=piece.num_rows)
                empty = np.bincount(of, minlength=piece.num_rows) == 0
                total[empty] = np.log1p(np.exp(model.bias))
                bad = np.flatnonzero(z >= 0)
                worst: list[str | None] = [None] * piece.num_rows
                for i in bad[np.argsort(z[bad], kind="stable")]:
                    worst[of[i]] = i
                worst = [None if i is None else raw[a[i] : b[i]].tobytes().decode(errors="replace") for i in worst]
                n_bad = np.bincount(of[bad], minlength=piece.num_rows) if len(bad) else np.zeros(piece.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(keep))] + [pa.array(-np.expm1(-total)), pa.array(n_bad.astype(np.int64)), pa.array(worst, pa.string())], names=out.names)
        release()

    return docs.select(*keep, text).mapInArrow(run, out)


def sentences(docs: DataFrame, model: Model, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence, probability of every sentence with at least that probability."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense().astype(np.float64)
        for batch in batches:
            for piece in slices(batch, 1, PIECE):
                bucket, sentence, of, a, b, raw = words_of(piece.column(1))
                some = weights[bucket] != 0
                pair = np.unique(sentence[some] * BUCKETS + bucket[some])
                p = 1 / (1 + np.exp(-np.bincount(pair // BUCKETS, weights=weights[pair % BUCKETS], minlength=len(of)) - model.bias))
                bad = np.flatnonzero(p >= least)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(of[bad])), pa.array([raw[a[i] : b[i]].tobytes().decode(errors="replace") for i in bad], pa.string()), pa.array(p[bad])], names=["doc_id", "sentence", "probability"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, sentence string, probability double")


def rejected_removed(docs: DataFrame, model: Model, most: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that score `most` or more; the columns stay as they are."""
    names = tuple(clear_of(docs.columns, n) for n in ("score", "n_offending", "worst_sentence"))
    other = tuple(docs.columns)
    return scored(docs, model, other, text, names).where(F.col(names[0]) < most).select(*other)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model)
    return rows.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_sentence")
