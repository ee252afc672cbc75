"""Phrase collocation mining: n-gram counts from word-id suffix arrays, merged over all shards, and scored exactly.

A shard is a block of documents. Its words are numbered by exact, corpus-wide ids; piece and document ends and words too
rare for any phrase are 0. For each phrase length a suffix array of the shard is built by prefix doubling in numpy, and the
LCP intervals of that length yield each n-gram with its count once. The n-grams of a shard go, dealt out by a hash of
their key, to tasks that sum the counts of equal keys; n-grams with at least `least` occurrences get an id there, and the
shard is told which of its n-grams have one (0: too rare).

The key of an n-gram is the id of its first n - 1 words and the id of its last word, so equal keys are equal word
sequences: nothing rests on hashes. As a phrase occurs no more often than any part of it, only n-grams both of whose
(n-1)-grams have ids are counted at all, and words outside such n-grams become 0 too, so shards shrink from level to level.

Scoring joins the n-grams that have ids, at most one for `least` words of a level, by ids: counts of all beginnings and
endings of a phrase grow with it along these joins. Ratios are whole-number divisions of decimals of 38 digits. A phrase
goes if one a word longer that contains it occurs as often; a longer phrase still that does has one a word longer in it.

Tokens: A-Z in lower case; pieces between . , ; : ! ? and line ends (\\n to \\r), words between spaces and tabs. Rows: a null
text is empty, a null language `und`; rows that repeat count each time; texts of any length are read whole, those longer
than a block are blocks of their own. Columns other than the language and the text are not read, whatever their names. An
empty table, or one without frequent phrases, gives no rows. Ties of scores go by count, then by the phrase's bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import LOWER, U, buffer_of, grouped, mix, pack, pack_sorted, release, span_hashes, unpack, unpack_sorted, word_spans
from .blocks import Answers, answered, packed, unpacked, write_blocks
from .common import partitions, shuffles_released, stored

#: Words in a bucket of keys, least and most (some 60 bytes each in a worker; between them the root of the corpus decides), and bytes to a shard.
BUCKET_WORDS, MOST_BUCKET_WORDS, SHARD_BYTES = 2_000_000, 8_000_000, 6 << 20
CUTS = np.zeros(256, dtype=bool)
CUTS[[*b".,;:!?", *range(10, 14)]] = True
BLANKS = CUTS.copy()
BLANKS[[0x20, 9]] = True


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def suffix_array(r: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the texts that begin there (up to the next 0, compared to at least `depth` ranks), and how many
    ranks each has in common with the one before it, at least up to `depth`. r: ranks, the last one 0."""
    zeros = np.flatnonzero(r == 0)
    length = zeros[np.searchsorted(zeros, np.arange(len(r)))] - np.arange(len(r))  # to the next 0
    ranks, h = [r.astype(np.int32)], 1
    while h < depth:
        second = np.zeros(len(r), dtype=np.int32)
        second[:-h] = ranks[-1][h:]
        second[length <= h] = 0
        ranks.append(grouped(ranks[-1].astype(U) << U(32) | second.astype(U))[1])
        h *= 2
    bits = max(1, (len(r) - 1).bit_length())
    order = (np.sort(ranks[-1].astype(U) << U(bits) | np.arange(len(r), dtype=U)) & U((1 << bits) - 1)).astype(np.int64)
    before, common = order[:-1], np.zeros(len(r), dtype=np.int64)
    for rank in reversed(ranks):
        h = 1 << (len(ranks) - 1)
        ranks = ranks[:-1]
        a, b = before + common[1:], order[1:] + common[1:]
        same = (length[a] >= h) & (length[b] >= h)
        same[same] = rank[a[same]] == rank[b[same]]
        common[1:] += h * same
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """LCP intervals: where in the order each run of places that share k ranks begins, and how long it is."""
    first = np.flatnonzero(common < k)
    return first, np.diff(np.append(first, len(order)))


def tokenised(lang: str, text: str):
    """Rows of a block to its shard: each word's number in the shard, which words begin a piece, and the (language, word) of each number with its count and hash."""

    def make(rows: pa.Table) -> tuple[bytes, int]:
        raw, offsets = buffer_of(rows.column(text).combine_chunks())
        buf = LOWER[raw]
        starts, ends, doc = word_spans(buf, offsets, BLANKS)
        cuts = np.cumsum(CUTS[buf], dtype=np.int64)
        begins = np.ones(len(starts), dtype=bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (cuts[starts[1:]] != cuts[ends[:-1] - 1])
        upto = np.append(0, np.cumsum(ends - starts))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(buf[~BLANKS[buf]].tobytes())])
        coded = words.dictionary_encode()
        langs = rows.column(lang).combine_chunks().dictionary_encode()
        code = np.asarray(langs.indices)[doc].astype(U) if len(doc) else np.zeros(0, U)
        at, which = grouped(code << U(32) | np.asarray(coded.indices).astype(U))
        order = np.argsort(starts[at])
        h = np.empty(len(at), U)
        h[order] = span_hashes(buf, starts[at][order], ends[at][order])
        by_lang = np.array([hash_of(x) for x in langs.dictionary.to_pylist()], dtype=U)  # the same in every shard
        names = pa.table([langs.dictionary.take(pa.array(code[at].astype(np.int64))), words.take(pa.array(at)), pa.array(np.bincount(which, minlength=len(at))), pa.array(mix(h ^ by_lang[code[at].astype(np.int64)]).view(np.int64))], names=["lang", "word", "n", "h"])
        shard = pa.table([pa.array([pack(which.astype(np.int64))], pa.binary()), pa.array([pack_sorted(np.flatnonzero(begins).astype(U))], pa.binary()), pa.array([packed(names)], pa.binary())], names=["which", "begins", "names"])
        return packed(shard), len(starts)

    return make


def hash_of(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return int(span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]) if len(raw) else 1


class Shard:
    """The words of a block, with a 0 before each piece and one at the end."""

    def __init__(self, payload: bytes):
        t = unpacked(payload)
        self.which, begins = unpack(t["which"][0].as_py()).astype(np.int64), unpack_sorted(t["begins"][0].as_py()).astype(np.int64)
        self.names = unpacked(t["names"][0].as_py())
        gap = np.zeros(len(self.which), dtype=np.int64)
        gap[begins] = 1
        self.at = np.arange(len(self.which)) + np.cumsum(gap)
        self.places = len(self.which) + len(begins) + 1

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of its words by bucket, and the bucket of each in that order."""
        bucket = bucket_of(np.asarray(self.names["h"]).view(U), n)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def numbered(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id at each place, and the rank of that id in the shard; 0 at ends and where a word has none."""
        distinct = np.unique(ids[ids > 0])
        rank = np.where(ids > 0, np.searchsorted(distinct, ids) + 1, 0)
        out, ranks = np.zeros(self.places, U), np.zeros(self.places, np.int32)
        out[self.at], ranks[self.at] = ids[self.which], rank[self.which]
        return out, ranks


def cuts_of(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each run of a bucket."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(bucket)))]


class Grams:
    """The n-grams of a shard that can be frequent, by bucket and key."""

    def __init__(self, word: np.ndarray, rank: np.ndarray, shorter: np.ndarray, k: int, base: int, buckets: int):
        """word, shorter: at each place the id of the word and of the (k-1)-gram there, 0 for none; base: over all word ids."""
        fine = np.zeros(len(word), dtype=bool)
        fine[:-1] = (shorter[:-1] > 0) & (shorter[1:] > 0)
        starts = np.flatnonzero(fine)
        edges = np.zeros(len(word) + 1, dtype=np.int32)
        edges[starts] += 1
        np.add.at(edges, starts + k, -1)
        covered = np.cumsum(edges[:-1]) > 0
        keep = covered.copy()
        keep[1:] |= covered[:-1]  # one 0 after each run of words
        keep[-1] = True
        self.place = np.flatnonzero(keep)
        order, common = suffix_array(np.where(covered, rank, 0)[self.place], k)
        first, n = intervals(order, common, k)
        group = np.repeat(np.arange(len(first)), n)
        at = self.place[order[first]]
        some = fine[at]
        at = at[some]
        key = shorter[at] * U(base) + word[at + k - 1]
        bucket = bucket_of(mix(key), buckets)
        by_key = np.argsort(key)
        by = by_key[np.argsort(bucket[by_key], kind="stable")]
        self.key, self.n, self.bucket = key[by], n[some][by], bucket[by]
        rank_of = np.full(len(first), -1, dtype=np.int64)
        rank_of[np.flatnonzero(some)[by]] = np.arange(len(by))
        self.entry = np.empty(len(order), dtype=np.int64)  # of each place that is kept
        self.entry[order] = rank_of[group]

    def ids(self, found: np.ndarray, places: int) -> np.ndarray:
        """The id of the n-gram at each place, from the ids of the entries."""
        out = np.zeros(places, U)
        mine = self.entry >= 0
        out[self.place[mine]] = found[self.entry[mine]]
        return out


QUESTION = "bucket int, block long, keys binary, n binary"
ANSWER = "level int, block long, bucket int, ids binary, grams binary, totals binary, most long"
ANSWERS = pa.schema([("level", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("grams", pa.binary()), ("totals", pa.binary()), ("most", pa.int64())])


def _questions(block: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table([pa.array([b for b, *_ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([k for _, k, _ in rows], pa.binary()), pa.array([n for *_, n in rows], pa.binary())], names=["bucket", "block", "keys", "n"])


def _numbered(total: np.ndarray, least: int, bucket: int, buckets: int) -> np.ndarray:
    """Ids for what is frequent, from 1, no two alike in any bucket, small for what occurs often; 0 for the rest."""
    ids = np.zeros(len(total), dtype=U)
    often = np.flatnonzero(total >= least)
    ids[often[np.argsort(-total[often], kind="stable")]] = np.arange(len(often), dtype=U) * U(buckets) + U(bucket + 1)
    return ids


def _answered(level: int, bucket: int, blocks: list[int], mine: list[np.ndarray], grams: pa.Table, totals: pa.Table | None, most: int) -> pa.Table:
    rows = [{"level": level, "block": b, "bucket": bucket, "ids": pack(x.astype(np.int64))} for b, x in zip(blocks, mine)]
    rows.append({"level": level, "bucket": bucket, "grams": packed(grams), "totals": packed(totals) if totals is not None else None, "most": most})
    return pa.Table.from_pylist(rows, schema=ANSWERS)


def _words_asked(buckets: int):
    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(payload.as_py())
                order, bucket = s.buckets(buckets)
                names = s.names.select(["lang", "word", "n"]).take(pa.array(order))
                yield from _questions(block, [(k, packed(names.slice(a, b - a)), b"") for k, a, b in cuts_of(bucket)]).to_batches()
                release()

    return ask


def _words_counted(least: int, buckets: int):
    def count(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [unpacked(x.as_py()) for x in rows["keys"]]
        every = pa.concat_tables(asked).combine_chunks()
        langs, words = (every[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
        at, group = grouped(np.asarray(langs.indices).astype(U) << U(32) | np.asarray(words.indices).astype(U))
        own = np.asarray(every["n"])
        total = np.zeros(len(at), dtype=np.int64)
        np.add.at(total, group, own)
        ids = _numbered(total, least, bucket, buckets)
        often = np.flatnonzero(ids)
        found = every.select(["lang", "word"]).take(pa.array(at[often])).append_column("id", pa.array(ids[often].astype(np.int64))).append_column("a", pa.array(total[often]))
        mine = np.split(ids[group], np.cumsum([t.num_rows for t in asked])[:-1])
        totals = every.group_by("lang").aggregate([("n", "sum")]).rename_columns(["lang", "n"])
        out = _answered(1, bucket, rows["block"].to_pylist(), mine, found, totals, int(ids.max(initial=0)))
        release()
        return out

    return count


def _grams_counted(level: int, least: int, buckets: int, base: int):
    def count(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [unpack_sorted(x.as_py()) for x in rows["keys"]]
        keys, own = np.concatenate(asked), np.concatenate([unpack(x.as_py()).astype(np.int64) for x in rows["n"]])
        at, group = grouped(keys)
        total = np.zeros(len(at), dtype=np.int64)
        np.add.at(total, group, own)
        ids = _numbered(total, least, bucket, buckets)
        often = np.flatnonzero(ids)
        some = keys[at[often]]
        found = pa.table([pa.array(x.astype(np.int64)) for x in (some // U(base), some % U(base), ids[often], total[often])], names=["p", "w", "id", "a"])
        out = _answered(level, bucket, rows["block"].to_pylist(), np.split(ids[group], np.cumsum([len(x) for x in asked])[:-1]), found, None, int(ids.max(initial=0)))
        release()
        return out

    return count


def _grams_asked(level: int, buckets: int, bases: list[int]):
    """Questions of a level, from the answers of those below. bases[0]: over all word ids."""

    def ask(block: int, payload: bytes, answers: pa.Table) -> pa.Table:
        s = Shard(payload)
        known = {(r["level"], r["bucket"]): r["ids"] for r in answers.select(["level", "bucket", "ids"]).to_pylist()}

        def told(level: int, bucket: np.ndarray) -> np.ndarray:
            ids = [unpack(known[level, b]).astype(U) for b, *_ in cuts_of(bucket)]
            return np.concatenate(ids) if ids else np.zeros(0, U)

        order, bucket = s.buckets(buckets)
        ids = np.empty(len(order), U)
        ids[order] = told(1, bucket)
        word, rank = s.numbered(ids)
        shorter = word
        for k in range(2, level):
            g = Grams(word, rank, shorter, k, bases[0], buckets)
            shorter = g.ids(told(k, g.bucket), s.places)
        g = Grams(word, rank, shorter, level, bases[0], buckets)
        return _questions(block, [(b, pack_sorted(g.key[x:y]), pack(g.n[x:y])) for b, x, y in cuts_of(g.bucket)])

    return ask


def _unpacked(rows: DataFrame, column: str, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                t = unpacked(x.as_py())
                if "word" in names:
                    t = t.set_column(t.schema.get_field_index("word"), "word", pc.cast(t["word"], pa.string()))
                yield from t.select(names).to_batches()

    return rows.where(F.col(column).isNotNull()).select(column).mapInArrow(run, schema)


def counted(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 5, least: int = 100) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, by level, the frequent n-grams: lang, word, id, a, then p (id of all but the last word), w (id of the last word), id, a."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = write_blocks(rows, "text", SHARD_BYTES, tokenised("lang", "text"))
    words = blocks.agg(F.sum("tokens")).first()[0] or 0
    size = min(max(100 * math.isqrt(words), BUCKET_WORDS), MOST_BUCKET_WORDS)
    buckets = max(1, -(-words // size))
    answers = Answers(blocks, "phrases")
    asked = blocks.select("block", "payload").mapInArrow(_words_asked(buckets), QUESTION)
    answers.add(asked.groupBy("bucket").applyInArrow(_words_counted(least, buckets), ANSWER))
    bases: list[int] = []
    for level in range(2, most + 1):
        top = answers.upto(level - 1).where(f"level = {level - 1}").agg(F.max("most")).first()[0] or 0
        bases.append(top + 1)
        if bases[0] * bases[-1] >= 1 << 64:
            raise ValueError(f"{bases[-1]} phrases and {bases[0]} words don't fit a key of 64 bits")
        known = answers.upto(level - 1).where("block is not null").select("part", "block", "level", "bucket", "ids")
        asked = answered(blocks, known, _grams_asked(level, buckets, bases), QUESTION)
        answers.add(asked.groupBy("bucket").applyInArrow(_grams_counted(level, least, buckets, bases[0]), ANSWER))
        shuffles_released(spark)
    found = answers.upto(most)
    total = stored(_unpacked(found.where("level = 1"), "totals", "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    first = stored(_unpacked(found.where("level = 1"), "grams", "lang string, word string, id long, a long"), "words")
    return total, [first, *(stored(_unpacked(found.where(f"level = {k}"), "grams", "p long, w long, id long, a long"), "grams") for k in range(2, most + 1))]


def described(totals: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """By length from 2: id, p, s (id of all but the first word), lang, phrase, a, n, lefts and rights: counts of the phrase's first and last 1, 2, ... words."""
    none = F.array().cast("array<bigint>")
    word = levels[0].join(totals, "lang").select("id", "lang", F.col("word").alias("phrase"), "a", "n")
    last = word.select(F.col("id").alias("w"), F.col("phrase").alias("w_phrase"), F.col("a").alias("w_a"))
    out: list[DataFrame] = []
    for k, grams in enumerate(levels[1:], 2):
        if k == 2:
            before = word.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("p_phrase"), F.col("a").alias("p_a"), "n", none.alias("p_lefts"))
            g = grams.join(before, "p").join(last, "w").withColumns({"s": F.col("w"), "s_a": F.col("w_a"), "s_rights": none})
        else:
            before = out[-1].select(F.col("id").alias("p"), F.col("s").alias("p_s"), "lang", F.col("phrase").alias("p_phrase"), F.col("a").alias("p_a"), "n", F.col("lefts").alias("p_lefts"))
            after = out[-1].select(F.col("id").alias("s"), F.col("p").alias("p_s"), "w", F.col("a").alias("s_a"), F.col("rights").alias("s_rights"))
            g = grams.join(before, "p").join(last, "w").join(after, ["p_s", "w"])
        g = g.select("id", "p", "s", "w", "lang", F.concat_ws(" ", "p_phrase", "w_phrase").alias("phrase"), "a", "n", F.concat("p_lefts", F.array("p_a")).alias("lefts"), F.concat("s_rights", F.array("s_a")).alias("rights"))
        out.append(stored(g, f"phrases-{k}"))
    return out


def scored(phrases: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases in no longer one that occurs as often."""
    kept = []
    for k, g in enumerate(phrases, 2):
        if k - 1 < len(phrases):
            longer = phrases[k - 1]
            inside = longer.select(F.col("p").alias("id"), "a").unionByName(longer.select(F.col("s").alias("id"), "a")).distinct()
            g = g.join(inside, ["id", "a"], "left_anti")
        cuts = []
        for j in range(1, k):
            l, r = F.col("lefts")[j - 1], F.col("rights")[k - j - 1]
            ratio = F.expr(f"(cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(lefts[{j - 1}] as decimal(19,0)) * cast(rights[{k - j - 1}] as decimal(19,0)))")
            cuts.append(F.struct(ratio.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
        kept.append(g.withColumn("best", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    out = kept[0]
    for g in kept[1:]:
        out = out.unionByName(g)
    return out


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of 2 to `most` words with `least` occurrences."""
    every = scored(described(*counted(docs, lang, text, most, least)))
    # the best of each share of a language first, then of fewer shares, so that no task gets all phrases of a language
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    n = partitions(docs.sparkSession)
    for shares in (n, math.isqrt(n), 1):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares)) if shares > 1 else F.lit(0)
        every = every.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(f"rank <= {top}")
    return every.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS t(k))
), c AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), t AS MATERIALIZED (
  SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang
), m AS MATERIALIZED (
  SELECT * FROM c WHERE f >= 100
), d AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM m WHERE k > 1
), s AS MATERIALIZED (
  SELECT d.lang, d.phrase, d.k, d.w, d.a, j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * d.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM d) d JOIN t ON t.lang = d.lang
  JOIN m x ON x.lang = d.lang AND x.phrase = array_to_string(list_slice(d.w, 1, j), ' ') JOIN m y ON y.lang = d.lang AND y.phrase = array_to_string(list_slice(d.w, j + 1, d.k), ' ')
), b AS MATERIALIZED (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), i AS MATERIALIZED (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN d ON d.lang = b.lang AND d.k > b.k AND 100 * d.a >= 100 * b.a AND contains(' ' || d.phrase || ' ', ' ' || b.phrase || ' ')
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
