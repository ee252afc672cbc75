import random

import pytest


def words(rng, n, size=40):
    return [f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls, empty, blank and long texts, repeated rows and ids, and columns whose names clash with inner ones."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(60):
        text = " ".join(words(rng, rng.randint(1, 150), 400))
        if i % 6 == 0:
            text += "\n" + passage + "\t" + " ".join(words(rng, 5))
        rows.append((i, text, ["en", "de", None][i % 3], [None, "src0", "src1", "src0"][i % 4], len(text)))
    rows += [(70, rows[0][1], "en", "src0", 1), (71, rows[1][1].replace("w", "W"), "en", "src0", 1), (72, rows[2][1] + " one", "en", "src1", 1)]
    rows += [(80, None, None, None, None), (81, "", "en", "src0", 0), (82, " \t\n ", "en", "src2", 4), (None, "no id here at all", "en", "src0", 3), (None, None, None, None, None)]
    rows += [(83, " ".join(words(rng, 30000, 30000)), "fr", "src1", 5), (84, "Ünïcode — “quotes” 日本語 \x1c x\x85y  ", "de", "src0", 2), (85, "a\r\nb\x0bc\x0cd", "de", "src0", 2)]
    rows += [rows[3], rows[3], (5, "another text under the same id", "en", "src0", 7)]
    df = spark.createDataFrame([(*r, f"x{k}", k, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, block string, size int, fp int")
    return df.repartition(3).cache()
