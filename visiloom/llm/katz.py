"""Katz backoff language model: training and scoring over blocks of documents.

Counts are discounted by Good-Turing up to `CUTOFF` (d_r = (r*/r - A) / (1 - A), A = (k + 1) n_{k+1} / n_1); the freed
mass goes to unseen continuations by exactly normalised backoff weights. P(w | h) = d c(hw) / c(h) where hw was seen, else
alpha(h) P(w | shorter h), down to the discounted unigrams, whose freed mass is the probability of the one unknown token.

Round n of the evaluation is the n-gram level. A block knows, for each of its tokens, the probability P at the level
below; it sends its distinct n-grams (history, word, training count, and what P follows from) to tasks that are dealt out by history. There
counts are summed, and for every history the backoff mass and the sum of the lower-level P over its seen words. The
answers (counts; backoff data where a block has unseen n-grams) go back to the block, which evaluates the next level.
They lie in one table, partitioned by level and bucketed as the blocks are, so they move once. Questions carry each n-gram
of a block once, as ids that the unigram table gives out by frequency. Histories with a large share of all tokens are dealt
out by n-gram instead of by history; their sums are put together and joined to the blocks that hold them.

Where Good-Turing can't be used (n_1 is 0 or a ratio isn't in (0, 1]), d_r = (r - 0.5) / r. A history none of whose
counts is discounted gives 1 / (c(h) + 1) to unseen words; unigrams likewise. So every distribution sums to exactly 1.

Tokens: words (bytes outside space, \\t to \\r) in lower case (A-Z), then one end. Rows: a null text counts as empty, only
the end; rows that repeat are texts of their own; a null id is in the held-out part. With no training text every
probability is 1. An empty table gives no rows. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, U, buffer_of, grouped, mix, pack, pack_floats, pack_sorted, release, span_hashes, unpack, unpack_floats, unpack_sorted, word_spans
from .blocks import Answers, answered, packed, unpacked, write_blocks
from .common import held_out, shuffles_released

CUTOFF = 5
#: Tokens to a count bucket, least and most (some 15 bytes each in a worker, see PART_GRAMS), and bytes to a block. Between them both the size and the number of buckets follow the root of the corpus, so messages from blocks to buckets shrink slowly.
BUCKET_TOKENS, MOST_BUCKET_TOKENS, BLOCK_BYTES = 1_000_000, 20_000_000, 6 << 20
#: N-grams of a bucket that are counted at once (some 90 bytes each).
PART_GRAMS = 500_000
END, START = U(0x5851F42D4C957F2D), U(0)
PAIR = U(0xC2B2AE3D27D4EB4F)


@dataclass
class Level:
    """Discounts of an n-gram order: d[r] for r <= CUTOFF, 1 above."""

    d: np.ndarray

    @classmethod
    def fitted(cls, n: list[int]) -> Level:
        """n[r - 1]: how many n-grams have count r, for r to CUTOFF + 1."""
        k = CUTOFF
        r = np.arange(1, k + 1)
        d = (r - 0.5) / r
        if all(n[:k]):
            a = (k + 1) * n[k] / n[0]
            star = (r + 1) * np.array(n[1 : k + 1]) / np.array(n[:k])
            if a < 1:
                found = (star / r - a) / (1 - a)
                if (found > 0).all() and (found <= 1).all():
                    d = found
        return cls(np.concatenate([[0.0], d]))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > CUTOFF, 1.0, self.d[np.minimum(counts, CUTOFF)])


@dataclass
class Model:
    order: int
    tokens: int = 0  # of training, ends included
    texts: int = 0
    types: int = 0
    levels: list[Level] = field(default_factory=list)
    unknown: float = 1.0
    scale: float = 1.0
    buckets: int = 1
    hot_least: int = 1000
    pairs: bool = True  # whether all ids are below 2^32

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, self.levels[0].of(c) * c / self.tokens * self.scale, self.unknown)

    def hot(self, c: np.ndarray) -> np.ndarray:
        """Histories that are dealt out by n-gram: fewer than 4 * buckets can have so many tokens."""
        return c > max(self.tokens / (4 * self.buckets), self.hot_least)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * PAIR + b)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _order(values: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of fewer than 2^bits values."""
    if len(values) and int(values.max()) >> (64 - bits):
        return np.argsort(values, kind="stable")
    return (np.sort(values << U(bits) | np.arange(len(values), dtype=U)) & U((1 << bits) - 1)).astype(np.int64)


def tokenised(order: int, doc_id: str, text: str, held: str):
    """Rows of a block to: distinct token hashes (sorted), each token's place among them, tokens of each text, flags and ids."""

    def make(rows: pa.Table) -> tuple[bytes, int]:
        raw, offsets = buffer_of(rows.column(text).combine_chunks())
        buf = LOWER[raw]
        starts, ends, doc = word_spans(buf, offsets)
        n = rows.num_rows
        words = np.bincount(doc, minlength=n)
        at = np.arange(len(doc)) + doc  # each text before adds an end
        h = np.full(len(doc) + n, END)
        h[at] = span_hashes(buf, starts, ends)
        first, which = grouped(h)
        vocabulary = h[first]
        out = pa.table([rows.column(doc_id), rows.column(held), pa.array(words + 1)], names=["id", "held", "n"])
        return packed(pa.table([pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([pack(which)], pa.binary()), pa.array([packed(out)], pa.binary())], names=["vocabulary", "which", "rows"])), len(which)

    return make


class Block:
    def __init__(self, payload: bytes):
        t = unpacked(payload)
        self.vocabulary = unpack_sorted(t["vocabulary"][0].as_py())
        self.which = unpack(t["which"][0].as_py()).astype(np.int64)
        self.rows = unpacked(t["rows"][0].as_py())
        self.n = np.asarray(self.rows["n"])
        self.begin = np.cumsum(self.n) - self.n
        self.train = np.repeat(~np.asarray(self.rows["held"].combine_chunks()), self.n) if len(self.n) else np.zeros(0, bool)

    def ranked(self, ids: np.ndarray) -> None:
        """The place of each of its words by id."""
        self.rank = np.empty(len(ids), dtype=np.int32)
        self.rank[np.argsort(ids)] = np.arange(len(ids), dtype=np.int32)

    def own_counts(self) -> np.ndarray:
        return np.bincount(self.which[self.train], minlength=len(self.vocabulary))

    def histories(self, n: int, ids: np.ndarray, pairs: bool, at: np.ndarray) -> np.ndarray:
        """For some tokens the id of the token before; the ids of the two before it, or for longer histories (or ids over 32 bits: no pairs) a hash of the ids of the n - 1 before it. Before a text come as many starts (0) as it takes."""
        out = np.zeros(len(at), U)
        place = at - np.repeat(self.begin, self.n)[at]
        for back in range(n - 1, 0, -1):
            before = np.where(place >= back, ids[self.which[at - back]], START)
            out = before if n == 2 else out << U(32) | before if n == 3 and pairs else pair_hash(out, before)
        return out

    def numbered(self, shorter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A token that is each distinct pair of words, or with the numbers of these for each token each three words, and the number of each token's, in the order of their ids."""
        word = self.rank[self.which]
        before = np.zeros(len(word), U)
        before[1:] = (word if shorter is None else shorter)[:-1]
        before[1:] += U(1)
        before[self.begin] = START
        return grouped(before << U(max(1, len(self.rank).bit_length())) | word.astype(U))


class Grams:
    """The distinct n-grams of a block at one level: their order, buckets, and what goes to each."""

    def __init__(self, block: Block, n: int, ids: np.ndarray, history_counts: np.ndarray, model: Model, shorter: np.ndarray | None = None):
        """shorter: the numbers of each token's pair, where n is 3."""
        exact = n == 2 or n == 3 and model.pairs
        if exact:
            first, self.group = block.numbered(shorter if n == 3 else None)
            h = block.histories(n, ids, model.pairs, first)
        else:
            history = block.histories(n, ids, model.pairs, np.arange(len(block.which)))
            first, self.group = grouped(pair_hash(history, ids[block.which]))
            h = history[first]
            del history
        word = block.rank[block.which[first]]
        # by history and word, as pairs and threes are numbered, then by bucket: values with places in their low bits sort fastest
        bits = max(1, (len(first) - 1).bit_length())
        order = None if exact else _order(grouped(h)[1].astype(U) << U(max(1, len(block.rank).bit_length())) | word.astype(U), bits)
        hot = model.hot(history_counts[first])
        bucket = bucket_of(mix(h), model.buckets)
        bucket[hot] = bucket_of(pair_hash(h[hot], ids[block.which[first[hot]]]), model.buckets)
        order = _order(bucket.astype(U), bits) if order is None else order[_order(bucket[order].astype(U), bits)]
        self.first = first[order]  # a token that is each n-gram, by bucket, history, word
        self.bucket, self.hot = bucket[order].astype(np.int32), hot[order]
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.inverse = rank[self.group]
        self.counts = np.bincount(self.inverse[block.train], minlength=len(first))
        self.h, self.word_rank = h[order], word[order]
        self.w = ids[block.which[self.first]]

    def cuts(self):
        at = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else np.zeros(0, np.int64)
        return [(int(self.bucket[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(self.bucket)))]


#: lower: training counts at the level below, of words at level 2 and of n-grams above; there P = d(lower) * lower * scale / whole, which belong to the shorter history.
QUESTION = "bucket int, block long, h binary, runs binary, hot binary, words binary, word binary, lower binary, whole binary, scales binary, scale binary, n binary"
HOT = -1  # in place of a bucket: what is known of a block's histories that were dealt out by n-gram
ANSWER = "block long, level int, bucket int, counts binary, places binary, mass binary, hot_h long, hot_sum double, hot_mass binary, hot array<long>, stats array<long>"


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers, none below 0, in the smallest unsigned width."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U)


def _stats(counts: np.ndarray) -> list[int]:
    """How many have count 1 .. CUTOFF + 1, how many any, and their sum."""
    return [int((counts == r).sum()) for r in range(1, CUTOFF + 2)] + [int((counts > 0).sum()), int(counts.sum())]


def _answer(**columns) -> pa.Table:
    kinds = {"block": pa.int64(), "level": pa.int32(), "bucket": pa.int32(), "counts": pa.binary(), "places": pa.binary(), "mass": pa.binary(), "hot_h": pa.int64(), "hot_sum": pa.float64(), "hot_mass": pa.binary(), "hot": pa.list_(pa.int64()), "stats": pa.list_(pa.int64())}
    n = max(len(v) for v in columns.values())
    return pa.table([pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], names=list(kinds))


def unigram_answers(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Block(payload.as_py())
                n, at = b.own_counts(), bucket_of(b.vocabulary, buckets)
                cuts = np.searchsorted(at, np.arange(buckets + 1))
                some = [(i, x, y) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, *_ in some], pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([pack_sorted(b.vocabulary[x:y]) for _, x, y in some], pa.binary()), pa.array([pack(n[x:y]) for _, x, y in some], pa.binary())], names=["bucket", "block", "h", "n"])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        words = [unpack_sorted(x) for x in rows["h"].to_pylist()]
        own = np.concatenate([unpack(x) for x in rows["n"].to_pylist()]).astype(np.int64)
        _, inverse = grouped(np.concatenate(words))
        total = np.bincount(inverse, weights=own).astype(np.int64)
        k = key[0].as_py()
        # ids: small for frequent words, from 1; they make the questions of higher levels small
        ids = np.empty(len(total), dtype=np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + k + 1
        ends = np.cumsum([len(w) for w in words])[:-1]
        mine, named = np.split(total[inverse], ends), np.split(ids[inverse], ends)
        return _answer(block=[*rows["block"].to_pylist(), None], level=[1] * (len(mine) + 1), bucket=[k] * (len(mine) + 1), counts=[*map(pack, mine), None], places=[*map(pack, named), None], stats=[None] * len(mine) + [[*_stats(total), int(total[inverse[np.concatenate(words) == END][:1]].sum()), int(ids.max())]])

    asked = blocks.select("block", "payload").mapInArrow(ask, "bucket int, block long, h binary, n binary")
    return asked.groupBy("bucket").applyInArrow(count, ANSWER)


def _shorter(h: np.ndarray, level: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of histories of a question one for each shorter history, and which one each has: pairs have that of their last word, hashes don't show theirs."""
    if level == 3 and model.pairs:
        return grouped(h & U(0xFFFFFFFF))
    return np.arange(len(h)), np.arange(len(h))


def _parts(sizes: np.ndarray, h: list[np.ndarray], runs: list[np.ndarray], most: int) -> list[U]:
    """Histories at which to cut a bucket of questions into parts of about `most` n-grams, by a sample of its histories: cuts decide on memory, not on results."""
    step = max(1, int(sizes.sum()) // 100_000)
    some, weight = np.concatenate([x[::step] for x in h]), np.concatenate([np.add.reduceat(r, np.arange(0, len(r), step), dtype=np.int64) if len(r) else r for r in runs])
    order = np.argsort(some, kind="stable")
    some, total = some[order], np.cumsum(weight[order])
    at = np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most))
    return np.unique(some[at]).tolist()


def _count_grams(level: int, model: Model, most: int = PART_GRAMS):
    """Counts of one bucket, which exist only here, and the answers for each block.

    Questions stay as narrow as they came; they are widened, sorted and counted for one range of histories after another, which hold
    about `most` n-grams (one history isn't cut), so memory hardly grows with the bucket."""

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        blocks, asked_of = rows["block"].to_pylist(), []
        for i in range(rows.num_rows):
            r = {c: rows[c][i].as_py() for c in rows.column_names if c not in ("bucket", "block")}
            h, runs = unpack_sorted(r["h"]), narrow(unpack(r["runs"]))
            lower = unpack(r["lower"])
            if level == 2:
                factors, shorter = model.unigram(lower.astype(np.int64)), None
            else:
                factors, shorter = unpack_floats(r["scales"], r["scale"]) / unpack(r["whole"]).astype(np.int64), narrow(_shorter(h, level, model)[1])
            asked_of.append((h, runs, unpack(r["hot"]).astype(bool), unpack_sorted(r["words"]), narrow(unpack(r["word"])), None if level == 2 else narrow(lower), factors, shorter, narrow(unpack(r["n"])), np.concatenate([np.zeros(1, np.uint32), np.cumsum(runs, dtype=np.uint32)])))
        del rows
        sizes = np.array([len(q[8]) for q in asked_of])
        cuts = _parts(sizes, [q[0] for q in asked_of], [q[1] for q in asked_of], most)
        ranges = [np.concatenate([[0], np.searchsorted(q[0], np.array(cuts, dtype=U)), [len(q[0])]]) for q in asked_of]
        told: list[list[tuple]] = [[] for _ in asked_of]
        stats, hots = np.zeros(CUTOFF + 3, np.int64), []
        for part in range(len(cuts) + 1):
            h, keys, p, n, hot, held = [], [], [], [], [], []
            for (h_, runs, hot_, words, word, lower, factors, shorter, n_, begin), at in zip(asked_of, ranges):
                x, y = at[part], at[part + 1]
                a, b, r = int(begin[x]), int(begin[y]), runs[x:y]
                h.append(np.repeat(h_[x:y], r))
                hot.append(np.repeat(hot_[x:y], r))
                keys.append(pair_hash(h[-1], words[word[a:b]]))
                p.append(factors[word[a:b]] if level == 2 else model.levels[level - 2].of(lower[a:b].astype(np.int64)) * lower[a:b] * np.repeat(factors[shorter[x:y]], r))
                n.append(n_[a:b].astype(np.int32))
                held.append(b - a)
            h, p, n, hot = map(np.concatenate, (h, p, n, hot))
            first, inverse = grouped(np.concatenate(keys))
            h, p, hot = h[first], p[first], hot[first]
            del keys, first
            total = np.bincount(inverse, weights=n, minlength=len(h)).astype(np.int64)
            at, of = grouped(h)
            histories = h[at]
            del h, at
            low = np.bincount(of, weights=np.where(total > 0, p, 0.0), minlength=len(histories))
            # mass[h]: how many continuations have each count to CUTOFF, then the sum of all counts
            mass = np.stack([np.bincount(of[total == r], minlength=len(histories)) for r in range(1, CUTOFF + 1)] + [np.bincount(of, weights=total, minlength=len(histories)).astype(np.int64)], axis=1)
            is_hot = np.zeros(len(histories), dtype=bool)
            is_hot[of] = hot
            ends = np.cumsum(held)[:-1]
            for i, (t, o) in enumerate(zip(np.split(total[inverse], ends), np.split(of[inverse], ends))):
                if not len(t):
                    continue
                at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))  # each history of the question
                unseen = np.bincount(np.cumsum(np.concatenate([[0], o[1:] != o[:-1]])), weights=t == 0, minlength=len(at)) > 0
                bare = (mass[o[at], :CUTOFF].sum(axis=1) == 0) & (mass[o[at], CUTOFF] > 0)
                want = np.flatnonzero((unseen | bare) & ~is_hot[o[at]])
                hs = o[at[want]]
                told[i].append((narrow(t), want + ranges[i][part], narrow(mass[hs].ravel()), low[hs], histories[np.unique(o[at][is_hot[o[at]]])].view(np.int64).tolist()))
            stats += _stats(total)
            hots += [(int(h_), float(s), pack(m)) for h_, s, m in zip(histories[is_hot].view(np.int64), low[is_hot], mass[is_hot])]
        del asked_of
        counts, places, masses, asked = [], [], [], []
        for i, parts in enumerate(told):
            t, want, m, s, a = zip(*parts) if parts else ([np.zeros(0, np.int64)],) * 4 + ([[]],)
            counts.append(pack(np.concatenate(t)))
            places.append(pack(np.concatenate(want)))
            masses.append(pack(np.concatenate(m)) + np.concatenate(s).astype("<f8").tobytes())
            asked.append([x for y in a for x in y] or None)
            told[i] = []
        k, m = key[0].as_py(), len(blocks)
        release()
        return pa.concat_tables([
            _answer(block=[*blocks, None], level=[level] * (m + 1), bucket=[k] * (m + 1), counts=[*counts, None], places=[*places, None], mass=[*masses, None], hot=[*asked, None], stats=[None] * m + [[*stats.tolist(), 0, 0]]),
            _answer(block=[None] * len(hots), level=[level] * len(hots), bucket=[k] * len(hots), hot_h=[x[0] for x in hots], hot_sum=[x[1] for x in hots], hot_mass=[x[2] for x in hots]),
        ])

    return count


class Evaluation:
    """Probabilities of a block's tokens, level by level, from the answers that it has had."""

    def __init__(self, block: Block, answers: pa.Table, model: Model):
        self.block, self.model = block, model
        self.answers = {(r["level"], r["bucket"]): r for r in answers.to_pylist()}
        own, self.ids = np.zeros(len(block.vocabulary), dtype=np.int64), np.zeros(len(block.vocabulary), dtype=U)
        at = bucket_of(block.vocabulary, model.buckets)
        cuts = np.searchsorted(at, np.arange(model.buckets + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                own[a:b] = unpack(self.answers[1, i]["counts"]).astype(np.int64)
                self.ids[a:b] = unpack(self.answers[1, i]["places"])
        block.ranked(self.ids)
        self.unigrams = own[block.which]
        self.p = model.unigram(self.unigrams)
        self.whole, self.scale, self.group = np.zeros(0, np.int64), np.zeros(0), None
        #: training count of the history of each token at the next level: of the token before, or how many texts there are
        self.history_counts = self._before(self.unigrams)

    def _before(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(len(counts), dtype=np.int64)
        out[1:] = counts[:-1]
        out[self.block.begin] = self.model.texts
        return out

    def grams(self, n: int) -> Grams:
        return Grams(self.block, n, self.ids, self.history_counts, self.model, self.group)

    def step(self, n: int) -> None:
        """From level n - 1 to level n."""
        g, model = self.grams(n), self.model
        d = model.levels[n - 1]
        total = np.zeros(len(g.first), dtype=np.int64)
        slot = np.full(len(g.first), -1, dtype=np.int32)  # into what is known of histories: masses and lower sums
        masses, lows, used = [np.zeros((0, CUTOFF + 1), np.int64)], [np.zeros(0)], 0
        for bucket, a, b in g.cuts():
            r = self.answers[n, bucket]
            total[a:b] = unpack(r["counts"]).astype(np.int64)
            where = unpack(r["places"]).astype(np.int64)
            if len(where):
                blob = r["mass"]
                lows.append(np.frombuffer(blob[-8 * len(where) :], "<f8"))
                masses.append(unpack(blob[: -8 * len(where)]).astype(np.int64).reshape(-1, CUTOFF + 1))
                run = np.cumsum(np.concatenate([[0], g.h[a + 1 : b] != g.h[a : b - 1]]))
                of_run = np.full(run[-1] + 1, -1, dtype=np.int32)
                of_run[where] = np.arange(used, used + len(where))
                slot[a:b] = of_run[run]
                used += len(where)
        if g.hot.any():
            table = self.answers[n, HOT]
            at = np.flatnonzero(g.hot)
            known = unpack_sorted(table["counts"])
            slot[at] = used + np.searchsorted(known, g.h[at])
            lows.append(np.frombuffer(table["mass"], "<f8"))
            masses.append(unpack(table["places"]).astype(np.int64).reshape(-1, CUTOFF + 1))
        mass, low = np.concatenate(masses), np.concatenate(lows)
        freed = (mass[:, :CUTOFF] * (np.arange(1, CUTOFF + 1) * (1 - d.d[1:]))).sum(axis=1)
        sums = mass[:, CUTOFF].astype(np.float64)
        bare = (freed <= 0) & (sums > 0)
        left = np.where(bare, 1 / (sums + 1), np.where(sums > 0, freed / np.maximum(sums, 1), 1.0))
        alpha = np.append(left / np.maximum(1 - low, 1e-300), 1.0)
        scale = np.append(np.where(bare, sums / (sums + 1), 1.0), 1.0)  # the last is for histories without an entry
        ch = self.history_counts[g.first]
        p = np.where(total > 0, d.of(total) * total / np.maximum(ch, 1) * scale[slot], np.where(ch > 0, alpha[slot], 1.0) * self.p[g.first])
        self.p, self.group = p[g.inverse], g.group
        self.totals, self.whole, self.scale = total[g.inverse], np.maximum(ch, 1)[g.inverse], scale[slot][g.inverse]  # counts of n-grams, of their histories, and these' scale
        self.history_counts = self._before(self.totals)


class KatzScorer:
    """Trains on the rows whose `held` flag is false and scores all. `answers` is a table of what its blocks were told, by level: neither n-grams nor backoff weights are kept.

    Columns other than the three named aren't read, so their names don't matter; texts of any length are a block of their own."""

    def __init__(self, docs: DataFrame, order: int = 2, doc_id: str = "doc_id", text: str = "text", held: str = "held_out", bucket_tokens: int | None = None, block_bytes: int = BLOCK_BYTES, hot_least: int = 1000, part_grams: int = PART_GRAMS):
        self.id_type = docs.schema[doc_id].dataType.simpleString()
        self.blocks = write_blocks(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(held).alias("h")), "t", block_bytes, tokenised(order, "id", "t", "h"))
        self.model, self.part_grams = Model(order, hot_least=hot_least), part_grams
        size = self.blocks.agg(F.sum("tokens")).first()[0] or 0
        each = bucket_tokens or min(max(BUCKET_TOKENS, int((100_000 * size) ** 0.5)), MOST_BUCKET_TOKENS)
        self.model.buckets = max(1, -(-size // each))
        self.answers = Answers(self.blocks, "katz")
        for level in range(1, order + 1):
            self.answers.add(unigram_answers(self.blocks, self.model.buckets) if level == 1 else self._gram_answers(level))
            self._learn(level)
            shuffles_released(docs.sparkSession)

    def _told(self, upto: int) -> DataFrame:
        return self.answers.upto(upto).where(F.col("block").isNotNull()).select("part", "block", "level", "bucket", "counts", "places", "mass")

    def _learn(self, level: int) -> None:
        mine, model = self.answers.upto(level).where(F.col("level") == level), self.model
        row = mine.where(F.col("stats").isNotNull()).agg(*[F.sum(F.col("stats")[i]) for i in range(CUTOFF + 4)], F.max(F.col("stats")[CUTOFF + 4])).first()
        *n, types, tokens, texts, top = (int(x or 0) for x in row)
        model.levels.append(Level.fitted(n))
        if level == 1:
            model.types, model.tokens, model.texts, model.pairs = types, tokens, texts, top < 1 << 32
            freed = sum(r * c * (1 - model.levels[0].d[r]) for r, c in zip(range(1, CUTOFF + 1), n))
            left = freed / tokens if tokens else 1.0
            model.unknown = max(left, 1 / (tokens + 1))
            model.scale = (1 - model.unknown) / (1 - left) if left < 1 else 1.0
        else:
            self.answers.add(self._hot_answers(mine, level))

    def _hot_answers(self, mine: DataFrame, level: int) -> DataFrame:
        """For each block that holds hot histories their masses and lower sums, put together from all buckets."""

        def put(key: tuple, rows: pa.Table) -> pa.Table:
            # in order of bucket, so that sums round alike on each run
            mass, low, at = np.zeros(CUTOFF + 1, np.int64), 0.0, np.argsort(np.asarray(rows["bucket"]), kind="stable")
            for i in at.tolist():
                mass += unpack(rows["hot_mass"][i].as_py()).astype(np.int64)
                low += rows["hot_sum"][i].as_py()
            return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([mass.tolist()], pa.list_(pa.int64())), pa.array([low])], names=["hot_h", "m", "s"])

        def tell(key: tuple, rows: pa.Table) -> pa.Table:
            h = np.asarray(rows["hot_h"]).view(U)
            at = np.argsort(h)
            mass = np.array(rows["m"].to_pylist(), dtype=np.int64)[at]
            return _answer(block=[key[0].as_py()], level=[level], bucket=[HOT], counts=[pack_sorted(h[at])], places=[pack(mass.ravel())], mass=[np.asarray(rows["s"])[at].astype("<f8").tobytes()])

        sums = mine.where(F.col("hot_h").isNotNull()).select("hot_h", "bucket", "hot_sum", "hot_mass").groupBy("hot_h").applyInArrow(put, "hot_h long, m array<long>, s double")
        asked = mine.where(F.col("hot").isNotNull()).select("block", F.explode("hot").alias("hot_h")).distinct()
        return asked.join(sums, "hot_h").groupBy("block").applyInArrow(tell, ANSWER)

    def _gram_answers(self, level: int) -> DataFrame:
        model = self.model

        def ask(number: int, payload: bytes, answers: pa.Table) -> pa.Table:
            out: dict[str, list] = {c.split()[0]: [] for c in QUESTION.split(", ")}
            e = Evaluation(Block(payload), answers, model)
            for k in range(2, level):
                e.step(k)
            g = e.grams(level)
            for bucket, a, b in g.cuts():
                h = g.h[a:b]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                at_word, word = grouped(g.word_rank[a:b].astype(U))
                words = g.w[a:b][at_word]
                # P at the level below follows from counts and, above words, a factor of the history
                tokens = g.first[a:b]
                lower = e.unigrams[tokens][at_word] if level == 2 else e.totals[tokens]
                shorter = tokens[at][_shorter(h[at], level, model)[0]] if level > 2 else at[:0]
                parts = pack(e.whole[shorter]), *pack_floats(e.scale[shorter])
                for c, v in zip(out, (bucket, number, pack_sorted(h[at]), pack(np.diff(np.append(at, b - a))), pack(g.hot[a:b][at].astype(np.int64)), pack_sorted(words), pack(word), pack(lower), *parts, pack(g.counts[a:b]))):
                    out[c].append(v)
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 10
            return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

        asked = answered(self.blocks, self._told(level - 1), ask, QUESTION)
        return asked.groupBy("bucket").applyInArrow(_count_grams(level, model, self.part_grams), ANSWER)

    def scores(self) -> DataFrame:
        """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        model = self.model

        def finish(number: int, payload: bytes, answers: pa.Table) -> pa.Table:
            b = Block(payload)
            e = Evaluation(b, answers, model)
            c = e.unigrams
            base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            for k in range(2, model.order + 1):
                e.step(k)
            of = np.repeat(np.arange(len(b.n)), b.n)
            total = lambda x: np.bincount(of, weights=x, minlength=len(b.n))
            columns = [b.rows["id"], b.rows["held"], pa.array(b.n), pa.array(total(c > 0).astype(np.int64)), pa.array(np.full(len(b.n), model.tokens, dtype=np.int64)), pa.array(total(base)), pa.array(total(np.log10(e.p)))]
            return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        schema = f"doc_id {self.id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return answered(self.blocks, self._told(model.order), finish, schema)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out("doc_id", 10).alias("held_out"))
    return KatzScorer(docs, order=3).scores()
