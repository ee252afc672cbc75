"""Each stage of the pipeline on its own input, and the whole."""

import hashlib
import os
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from visiloom.llm import bpe, toxicity
from visiloom.llm.common import stored

from .test_operators import WORD, kept_words, plain_components, plain_fingerprint, plain_targets, plain_toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        seen[name] = docs
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    assert 0 < seen["toxicity"].count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert seen["simhash_near_dedup"].count() < seen["toxicity"].count()
    assert seen["substring_dedup"].count() == seen["simhash_near_dedup"].count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() and out.where("size(ids) <> n_tokens").count() == 0


def test_stages_on_odd_rows(spark, odd_documents, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() > 0
    docs = odd_documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() == 0


def against_plain(spark, docs, labels, sf_dir):
    """Runs every stage on its predecessor's rows and compares what it keeps, cuts, takes and encodes with plain Python."""
    names = docs.columns

    def rows(df):
        return [r.asDict() for r in df.collect()]

    def same(got, want):
        def count(xs):
            return Counter(tuple(x[c] for c in names) for x in xs)

        assert count(got) == count(want)

    stages = [f for _, f in corpus_pipeline.STAGES]
    model = toxicity.fit(docs, labels)
    frames, left = [docs], rows(docs)
    for k, stage in enumerate(stages):
        frames.append(stored(stage(spark, frames[-1], sf_dir), f"stage{k}"))
    clean, single, cut, mixed, out = (rows(f) for f in frames[1:])

    same(clean, [r for r in left if plain_toxicity(model, r["text"]) < 0.5])

    prints = [plain_fingerprint(r["text"]) for r in clean]
    group = plain_components(prints)
    first = {}
    for r, f in zip(clean, prints):
        i = r["doc_id"]
        first.setdefault(group[f], []).append((i is None, i or 0))
    ids = sorted((group[plain_fingerprint(r["text"])], r["doc_id"] is None, r["doc_id"] or 0) for r in single)
    assert ids == sorted((g, *min(members)) for g, members in first.items())
    assert not Counter(map(repr, single)) - Counter(map(repr, clean))

    words = kept_words([r["text"] for r in single], 35)
    want = Counter((r["doc_id"], tuple(w), None if r["text"] is None or WORD.findall(r["text"]) != w else r["text"]) for r, w in zip(single, words))
    unchanged = {(r["doc_id"], r["text"]) for r in single}
    got = Counter((r["doc_id"], tuple(w := WORD.findall(r["text"] or "")), r["text"] if r["text"] is not None and (r["doc_id"], r["text"]) in unchanged else None) for r in cut)
    assert got == want and all(r["n_chars"] is None or r["text"] is None or r["n_chars"] == len(r["text"]) for r in cut)

    size, sizes, taken, largest = {}, Counter(), Counter(), Counter()
    have = Counter(repr(r) for r in cut)
    for r in cut:
        n = size[repr(r)] = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r, n in Counter(map(repr, mixed)).items():
        assert n <= 3 * have[r] and size[r] > 0
    for r in mixed:
        taken[r["source"]] += size[repr(r)]
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(0.02 * t, largest[s] / 2), s

    own = bpe.PrefixBpe.load("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("t", pat_str=own.split.pattern, mergeable_ranks=own.ranks, special_tokens={})
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in out) == Counter((r["doc_id"], len(i := other.encode_ordinary(r["text"] or "")), tuple(i), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in mixed)
    return [len(x) for x in (left, clean, single, cut, mixed, out)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_against_plain(spark):
    before, clean, single, cut, mixed, out = against_plain(spark, spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), SF)
    assert before > clean > single == cut and mixed == out > 0


def test_odd_rows_against_plain(spark, odd_documents, tmp_path):
    labels = spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    against_plain(spark, odd_documents, labels, str(tmp_path))
