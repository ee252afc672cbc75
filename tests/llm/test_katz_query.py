"""The registered query scores with trigrams."""

import zlib

from visiloom.llm.katz import op1_katz

from .test_katz import Plain, tokens


def test_query_uses_two_words_of_context(spark, tmp_path):
    # what follows b depends on the word before it, which a bigram can't see
    texts = {i: ["a b c", "x b d"][i % 2] for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: round(r.score, 6) for r in op1_katz(spark, str(tmp_path)).collect()}
    train = [tokens(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    two, three = Plain(train, 2), Plain(train, 3)
    assert got == {i: round(three.score(tokens(t)), 6) for i, t in texts.items()}
    assert got != {i: round(two.score(tokens(t)), 6) for i, t in texts.items()}
