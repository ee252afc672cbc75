"""Tables that grow with the corpus are not built in the driver: no broadcast joins, however small or well packed their files."""

import random

from visiloom.llm import graph, mixing, simhash
from visiloom.llm.common import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_and_components_do_not_broadcast(spark):
    rng = random.Random(2)
    docs = stored(spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(9)), "en") for i in range(200)], "doc_id long, text string, lang string"), "docs")
    fps = stored(simhash.fingerprints(docs).select("fp").distinct(), "fps")
    e = stored(simhash.edges(fps), "e")
    frames = [simhash.edges(fps), simhash.near_duplicates(docs), simhash.one_of_each(docs), graph._large(e), graph._small(e)]
    assert not ["Broadcast" in plan(f) for f in frames].count(True)


def test_cells_of_the_mix_are_not_broadcast(spark):
    rng = random.Random(3)
    docs = stored(spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string"), "docs")
    assert "Broadcast" not in plan(mixing.mixed(docs))
