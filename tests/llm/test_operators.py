"""Operators on odd rows against brute force; empty tables; round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from visiloom.llm import bpe, chat, mixing, quality, simhash, substrings, token_shards, topk, toxicity
from visiloom.llm.blocks import unpacked
from visiloom.llm.common import scratch, stored, listed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- substrings


def kept_words(texts, width):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append([x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("width", [1, 2, 5, 35])
def test_substrings(spark, odd_documents, width):
    got = rows_of(substrings.deduplicated(odd_documents, width=width), "block", "text")
    rows = rows_of(odd_documents, "block", "text")
    want = dict(zip((k for k, _ in rows), kept_words([t for _, t in rows], width)))
    assert len(got) == len(rows)
    before = dict(rows)
    for k, t in got:
        assert WORD.findall(t or "") == want[k], k
        if before[k] is None or WORD.findall(before[k]) == want[k]:
            assert t == before[k]
    assert substrings.deduplicated(odd_documents, width=width).columns == odd_documents.columns


def test_substrings_in_batches(spark, odd_documents):
    """Runs that are merged and compacted find what one batch does; history is told of new repeats."""
    many = odd_documents.repartition(7)
    one = sorted(rows_of(substrings.judged(many.select("block", "text"), "text", lambda t, w, g: t.select(["block"]).append_column("n", [[int(g.sum())] * t.num_rows]), "block string, n long", 5, 1), "n"))
    five = sorted(rows_of(substrings.judged(many.select("block", "text"), "text", lambda t, w, g: t.select(["block"]).append_column("n", [[int(g.sum())] * t.num_rows]), "block string, n long", 5, 5), "n"))
    assert sum(n for (n,) in one) == sum(n for (n,) in five)
    index = substrings.FingerprintIndex(spark, width=5)
    a = spark.createDataFrame([("one two three four five six",)], "text string")
    assert index.add(substrings.write_blocks(a, "text")).count() == 0
    assert index.add(substrings.write_blocks(a, "text", first_part=100)).select("block").distinct().count() == 2
    index.compact(2)
    assert len(index.runs) == 1 and index.add(substrings.write_blocks(a, "text", first_part=200)).select("block").distinct().count() == 3


def test_runs_are_merged_by_tiers(spark):
    """Sixteen batches leave few runs, and an entry is rewritten once a tier."""
    index = substrings.FingerprintIndex(spark, width=3)
    written, write = [], index._write
    index._write = lambda rows: written.append(1) or write(rows)
    runs = []
    for k in range(16):
        df = spark.createDataFrame([(f"w{k} x{k} y{k} z{k} shared words here",)], "text string").coalesce(1)
        index.add(substrings.write_blocks(df, "text", first_part=10 * k))
        index.compact()
        runs.append(len(index.runs))
    assert runs == [1, 2, 3, 1, 2, 3, 4, 2, 3, 4, 5, 3, 4, 5, 6, 1] and len(written) == 16 + 4 + 1
    assert len([n for n in listed(spark, index.path) if n.startswith("run-")]) == 1


def test_corpus_in_sessions(spark, odd_documents, tmp_path):
    """Batches added in sessions of their own give what one pass over all documents gives; earlier documents follow, others aren't touched."""
    path = str(tmp_path / "corpus")
    now, seen = {}, []
    for k in range(4):
        batch = odd_documents.where(F.col("size") % 4 == k) if k < 3 else odd_documents.where("size % 4 = 3 and size < 60")
        seen += [r["size"] for r in batch.collect()]
        new, earlier = substrings.Corpus(spark, path, width=5).add(batch.repartition(5))
        fresh, revised = rows_of(new, "size", "text"), rows_of(earlier, "size", "text")
        assert sorted(i for i, _ in fresh) == sorted(r["size"] for r in batch.collect()) and {i for i, _ in revised} <= set(now)
        assert new.columns == odd_documents.columns and (k == 0) == (not revised)
        now |= dict(fresh) | dict(revised)
        rows = [(r["size"], r.text) for r in odd_documents.collect() if r["size"] in seen]
        for (i, before), want in zip(rows, kept_words([t for _, t in rows], 5)):
            assert WORD.findall(now[i] or "") == want, (k, i)
            assert (now[i] is None) == (before is None)
    numbers = spark.read.parquet(*[f"{path}/{f}" for f in listed(spark, path) if f.startswith("blocks-")]).select("block").collect()
    assert len(numbers) == len({r.block for r in numbers})
    with pytest.raises(ValueError, match="columns"):
        substrings.Corpus(spark, path, width=5).add(odd_documents.select("text"))
    none, _ = substrings.Corpus(spark, path, width=5).add(odd_documents.where("false"))
    assert none.count() == 0


def test_substring_index_is_reopened(spark):
    """An index of batches A and B, opened again by its path, finds which blocks of history a batch C repeats; old runs are gone."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(24)]
    frame = lambda k: substrings.write_blocks(spark.createDataFrame([(t,) for t in texts[k::3]], "text string").repartition(8), "text", 1, first_part=8 * k)
    batches = [frame(k) for k in range(3)]
    index = substrings.FingerprintIndex(spark, width=5)
    for b in batches[:2]:
        index.add(b)
    index.compact(2)
    kept = [n for n in listed(spark, index.path) if n.startswith("run-")]
    assert kept == [f for f, *_ in index.runs] and len(kept) == 1
    opened = substrings.FingerprintIndex(spark, width=5, path=index.path)
    assert [f for f, *_ in opened.runs] == kept
    hits = {r.block for r in opened.add(batches[2]).collect()}
    held = {r.block: unpacked(bytes(r.payload)).column("text").to_pylist() for b in batches for r in b.collect()}
    windows = {k: Counter(tuple(w[i : i + 5]) for t in ts for w in [t.split()] for i in range(len(w) - 4)) for k, ts in held.items()}
    new = Counter(w for k, c in windows.items() if k >> 35 == 2 for w in c.elements())
    total = Counter(w for c in windows.values() for w in c.elements())
    must = {k for k, c in windows.items() if any(total[w] > 1 and new[w] for w in c)}
    assert must and must <= hits
    with pytest.raises(ValueError, match="windows of 5"):
        substrings.FingerprintIndex(spark, width=6, path=index.path)


# --- top-k


def test_topk(spark):
    rng = np.random.RandomState(2)
    rows = [(i, [float(x) for x in rng.randn(6) * (1 + i % 3)]) for i in range(300)]
    rows += [(50, [0.1] * 6), (301, rows[7][1]), (302, rows[7][1]), (303, None), (304, [float("nan")] * 6), (305, [1.0, None]), (306, []), (307, [2.0, 2.0]), (None, [1.0] * 6)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()}
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, v + [0] * (6 - len(v))) for i, v in fine]
    for q in range(0, 300, 50):
        mine = min(v for i, v in fine if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in fine if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    # components beyond what doubles add exactly: whole numbers, scores clipped to a long's range
    huge = [(0, [1e8, -3.0, 2e9]), (1, [1e8, 5.0, 1.0]), (2, [1e8, 5.0, 2.0]), (3, [1e30, 0.0, 0.0]), (4, [-1e30, 0.0, 1.0]), (50, [0.0, 1.0, 0.0]), (51, [3.0, 3.0, 3.0])]
    few = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(*(topk.quantised(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).where(c) for c in ("true", "vec_id % 50 = 0")), 5).collect()}
    whole = {i: [min(max(math.floor(256 * x), -(1 << 63)), (1 << 63) - 1) for x in v] for i, v in huge}
    for q in (0, 50):
        clipped = {i: min(max(sum(a * b for a, b in zip(whole[q], v)), -(1 << 63)), (1 << 63) - 1) for i, v in whole.items() if i != q}
        assert [few[q, k + 1] for k in range(5)] == sorted(clipped.items(), key=lambda x: (-x[1], x[0]))[:5]
    few = topk.top_k(vectors.where("vec_id < 2"), vectors.where("vec_id = 0"), 5).collect()
    assert [(r.vec_id, r["rank"]) for r in few] == [(1, 1)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


# --- mixing


def plain_targets(sizes):
    """Target of each source from the sources' sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: share * weight[s] for s in open_}
    return target


def test_mixing(spark, odd_documents):
    sized = stored(odd_documents.select("doc_id", "source", "block", mixing.n_words("text").alias("size")), "t")
    rows = mixing.with_copies(sized, "size", "mix").select("block", "size", "source", "mix.*").collect()
    assert len(rows) == odd_documents.count()
    assert {r.block: r["size"] for r in rows} == {k: len(WORD.findall(t or "")) for k, t in rows_of(odd_documents, "block", "text")}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    order, target = list(sizes), plain_targets(sizes)
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(t, 6) for s, t in target.items()}
    taken = Counter()
    for r in rows:
        assert 0 <= r.n <= 3 and (r.n == 0 or r["size"] > 0)
        taken[r.source] += r.n * r["size"]
    largest = {s: max(r["size"] for r in rows if r.source == s) for s in order}
    for s in order:  # one copy of one document can be all that is left to choose
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2), (s, taken[s], target[s])
    again = mixing.with_copies(sized.repartition(5), "size", "mix").select("block", "mix.n").collect()
    assert Counter((r.n) for r in again) == Counter(r.n for r in rows)
    mixed = mixing.mixed(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() == sum(r.n for r in rows)
    assert mixing.mixed(odd_documents.limit(0)).count() == 0


def test_rates_are_exponential(spark):
    cells = spark.createDataFrame([("a", n, 3) for n in (10, 20, 40, 80)], "source string, size long, m long")
    wanted = spark.createDataFrame([("a", 450, 300.0)], "source string, source_size long, target double")
    got = {r["size"]: r.rate for r in mixing.rates(cells, wanted).collect()}
    assert sum(3 * s * x for s, x in got.items()) == pytest.approx(300, rel=1e-6)
    assert math.log(got[40]) / math.log(got[20]) == pytest.approx(2, rel=1e-4) and got[80] < got[40] < 1


# --- token shards


def test_token_shards(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text", F.lit(1).alias("part"), F.lit(1).alias("data"))
    dictionary = token_shards.fitted_dictionary(docs, "byte_bpe_50k.json", 0)
    path = scratch(spark, "t")
    token_shards.write_shards(docs, path, dictionary)
    got = token_shards.read_shards(spark, path).collect()
    of = token_shards.Encoder("byte_bpe_50k.json", 0).of
    ids = [(i, of.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows_of(docs, "doc_id", "text")]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0] + [r.n_tokens for r in order])[:-1])
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)
    # single documents, from the path alone
    read = Counter((r.doc_id, tuple(r.ids)) for r in token_shards.documents(spark, path, [5, 83, 9999]).collect())
    assert read == Counter((i, tuple(x)) for i, x in ids if i in (5, 83))
    shard = spark.read.parquet(f"{path}/shards").first()
    one = token_shards.Shard(bytes(shard.data), dictionary)
    assert len(one.document(0)) == 4 * int(one.counts[0])
    with pytest.raises(ValueError, match="dictionary"):
        token_shards.Shard(bytes(shard.data), dictionary + b"x")
    empty = scratch(spark, "t")
    token_shards.write_shards(docs.limit(0), empty, b"")
    assert token_shards.read_shards(spark, empty).count() == 0


def test_dictionary_takes_whole_documents(spark, odd_documents):
    """The same bytes however rows are dealt out, though ids repeat; nothing of a text is cut off."""
    docs = odd_documents.select("doc_id", "text")
    more = docs.unionByName(docs.select("doc_id", F.concat("text", F.lit(" more")).alias("text")))
    one = token_shards.fitted_dictionary(more.repartition(5, "text"), "byte_bpe_50k.json", 0)
    assert one and one == token_shards.fitted_dictionary(more.coalesce(1), "byte_bpe_50k.json", 0)


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    bad, fine = ["grumble", "snarl"], [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choices(fine, k=8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at] + " " + rng.choice(bad).upper()
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "x"), rows[0], rows[0]]
    labels += [(2, None), (None, 1), labels[3]]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert 0 <= got[1000].score < 0.5 and got[1000].score == got[1001].score and len(toxicity.scored(docs, model).collect()) == len(rows)
    found = toxicity.sentences(docs, model).collect()
    assert found and all(any(b in r.sentence.lower() for b in bad) for r in found)
    kept = toxicity.rejected_removed(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 0 and kept.where("doc_id = 1").count() == 1
    again = toxicity.fit(docs.repartition(5), lab)
    assert np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)
    none = toxicity.fit(docs, lab.limit(0))
    assert toxicity.scored(docs, none).count() == len(rows) and toxicity.scored(docs.limit(0), model).count() == 0


# --- simhash


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {f: root(f) for f in distinct}


def test_simhash(spark, odd_documents):
    got = rows_of(simhash.near_duplicates(odd_documents), "doc_id", "fingerprint", "component_id")
    rows = rows_of(odd_documents, "doc_id", "text")
    fps = [plain_fingerprint(t) for _, t in rows]
    of = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    assert Counter(got) == Counter((i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, fps))
    kept = rows_of(simhash.one_of_each(odd_documents), "doc_id", "text")
    assert len(kept) == len(set(of.values())) and len({of[plain_fingerprint(t)] for _, t in kept}) == len(kept)
    assert simhash.one_of_each(odd_documents).columns == odd_documents.columns
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0


def test_edges_of_dense_groups(spark):
    """Groups beyond PAIRS keep every link's connection and make none of their own."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    flips = lambda n, bits: sum(1 << b for b in rng.sample(bits, n))
    fps = {centre ^ flips(rng.randint(0, 4), range(64)) for _ in range(300)} | {centre ^ flips(rng.randint(0, 5), range(12)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    e = [(u % (1 << 64), v % (1 << 64)) for u, v in rows_of(simhash.edges(df), "u", "v")]
    assert all((u ^ v).bit_count() <= 2 for u, v in e)
    want = plain_components(fps)
    from visiloom.llm.graph import components

    got = {n % (1 << 64): r % (1 << 64) for n, r in rows_of(components(simhash.edges(df)), "node", "root")}
    same = lambda of: {frozenset(f for f in fps if of.get(f, f) == r) for r in {of.get(f, f) for f in fps}}
    assert same(got) == same(want)


# --- BPE


def test_bpe(spark, odd_documents):
    own = bpe.PrefixBpe.load("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("t", pat_str=own.split.pattern, mergeable_ranks=own.ranks, special_tokens={})
    got = rows_of(bpe.encoded(odd_documents, keep=("block",), ids=True), "block", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    texts = dict(rows_of(odd_documents, "block", "text"))
    assert len(got) == len(texts)
    for k, n, a, b, ids in got:
        want = other.encode_ordinary(texts[k] or "")
        assert (n, ids) == (len(want), want)
        assert a == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and b == hashlib.sha256((texts[k] or "").encode()).hexdigest()
        assert own.decode(ids) == (texts[k] or "").encode()
    rng, letters = random.Random(9), "ab '’st\n\t  .,1é日\x1c  LlDd\r-_"
    for _ in range(300):
        cur = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        e = bpe.EncodedText(own, cur)
        for _ in range(4):
            y = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
            if rng.random() < 0.5:
                e.append(y)
                cur += y
            else:
                s = rng.randint(0, len(cur))
                t = rng.randint(s, min(len(cur), s + 5))
                e.edit(s, t, y)
                cur = cur[:s] + y + cur[t:]
            assert e.ids() == other.encode_ordinary(cur), cur
    assert bpe.encoded(odd_documents.limit(0)).count() == 0


def test_prefix_table():
    own = bpe.PrefixBpe.load("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("t", pat_str="(?s:.+)", mergeable_ranks=own.ranks, special_tokens={})
    piece = b" unbelievably"
    last = own.extend(piece, [])
    for i in range(1, len(piece) + 1):
        assert last[i - 1] == other.encode_ordinary(piece[:i].decode())[-1]


# --- chat


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\|im_start|>", "<|im_start", "<", "", None, "日本\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", nasty[0]), ("user", nasty[1]), ("assistant", nasty[0]), ("user", nasty[2]), ("assistant", nasty[1] + nasty[6])])]
    rows += [(2, 0, "assistant", nasty[4]), (2, 1, "assistant", nasty[5]), (None, 0, "user", "no id"), (3, None, None, "x"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "odd\nrole\\n", "t\nu"), (5, 1, nasty[1], "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df.repartition(3))).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "unknown", x or "") for k, t, r, x in rows if k == c))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        g = got[c]
        assert g.n_turns == len(mine) and g.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.formatted_chars == sum(len(f"<|im_start|>{chat.role_line(r)}\n{chat.escape(x)}<|im_end|>\n") for _, _, r, x in mine)
    made = chat.Template("byte_bpe_50k.tiktoken")
    for r in [*filter(None, nasty), "odd\nrole\\n", "\\n"]:
        assert chat.role_of(chat.role_line(r)) == r
        ((ids, mask),) = made.turns([r], ["t\nu"])
        assert list(made.read(ids, mask)) == [(r, "t\nu", "")]
    for t in filter(None, nasty):
        assert chat.unescape(chat.escape(t)) == t and not re.search(r"<\|im_(start|end)\|>", chat.escape(t))
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# --- quality


def test_quality(spark, odd_documents):
    repeat = "one two three\none two three\nfour # five $\n\n \nfour # five $"
    more = spark.createDataFrame([(900, repeat), (901, "x y z " * 40), (902, "a b"), (903, "\x0b\n\x0b")], "doc_id long, text string")
    docs = odd_documents.unionByName(more, allowMissingColumns=True)
    counts = stored(quality.counted(docs, ("doc_id", "lang", "source", "block")), "t")
    texts = Counter((i, t) for i, t in rows_of(docs, "doc_id", "text"))
    want = Counter()
    for (i, t), n in texts.items():
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        again = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        want[i, len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += n
    assert Counter(rows_of(counts, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    judged = quality.verdicts(counts)
    assert judged.count() == docs.count() and judged.where("kept and base_failed").count() == 0
    assert quality.verdicts(stored(quality.counted(docs.limit(0)), "t")).count() == 0


def test_quality_thresholds_adapt(spark):
    """The same share of symbols is kept where it is usual and rejected where it isn't."""
    rng = random.Random(3)
    make = lambda n: " ".join(("#" if k < n else f"w{rng.randrange(5000)}") for k in range(100))
    rows = [(i, make(40 + i % 5), "en", "code") for i in range(60)] + [(100 + i, make(i % 3), "en", "prose") for i in range(60)] + [(200, make(42), "en", "prose"), (201, make(42), "en", "code")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.verdicts(stored(quality.counted(docs), "t")).collect()}
    assert not got[200] and got[201] and all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60))


def test_quality_stays_native(spark, odd_documents):
    plan = quality.verdicts(stored(quality.counted(odd_documents), "t"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_keeps_columns_of_any_name(spark, odd_documents):
    names = ("length", "symbol", "repeat", "dup_line", "symbol_most", "n")
    named = odd_documents.select("doc_id", "lang", "source", "text", *[F.concat(F.lit(n), "block").alias(n) for n in names])
    counts = stored(quality.counted(named, ("doc_id", "lang", "source", *names)), "t")
    rows = quality.verdicts(counts).collect()
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(tuple(r) for r in named.select(*names).collect())
    plain = quality.verdicts(stored(quality.counted(odd_documents), "t")).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in rows) == Counter((r.doc_id, r.n_words, r.kept) for r in plain)


def test_mix_of_rows_that_share_an_id(spark):
    """Of equal ids and sizes with different texts the same ones are taken, however rows are dealt out."""
    rows = [(1, f"{a} {b} c", "s" if a < "m" else "t") for a in "abcdefgnopqrs" for b in "xyz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = Counter(r.text for r in mixing.mixed(docs.repartition(5, "text")).collect())
    assert one == Counter(r.text for r in mixing.mixed(docs.coalesce(1).orderBy(F.desc("text"))).collect())


def plain_toxicity(model, text):
    """Noisy-or over sentences, from the fitted weights."""
    weight, miss, n = dict(zip(model.buckets.tolist(), model.weights.tolist())), 1.0, 0
    for sentence in re.split(r"[\n!.?]", text or ""):
        if re.search(r"[0-9A-Za-z']", sentence):
            bucket, *_ = toxicity.words_of(pa.array([sentence]))
            z = sum(weight.get(b, 0.0) for b in set(bucket.tolist())) + model.bias
            miss, n = miss / (1 + math.exp(min(max(z, -30), 30))), n + 1
    return 1 - (miss if n else 1 / (1 + math.exp(model.bias)))


def test_toxicity_scores_are_noisy_or(spark):
    """Scores against a plain noisy-or over sentences, from the fitted weights."""
    docs = [(i, f"calm words here. {'vile wretch' if i % 3 == 0 else 'kind friend'} number {i}! More text\nend {i % 7}") for i in range(120)] + [(200, None), (201, ""), (202, " . ! ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    for r in toxicity.scored(frame, model).collect():
        assert abs(r.score - plain_toxicity(model, dict(docs)[r.doc_id])) < 1e-6, r


def test_long_pieces_take_time_in_proportion():
    """A run of letters without a space is one piece: ids as tiktoken's, and four times the length takes no sixteen times the time."""
    import time

    import public_tokenizers

    encoder = bpe.PrefixBpe.load("byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    took = {}
    for n in (100_000, 400_000):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        began = time.perf_counter()
        ids = encoder.encode(text)
        took[n] = time.perf_counter() - began
        assert encoder.decode(ids) == text.encode()
    assert took[400_000] < 8 * took[100_000] + 1
    some = "".join(rng.choice("etaoin") for _ in range(20_000))
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    assert encoder.encode(some) == known.encode_ordinary(some)
