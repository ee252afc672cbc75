"""Seeded percentile bootstrap intervals of means.

The draws are those of CPython's Mersenne Twister, seeded by a hash of the group's label, so intervals are reproducible
bit for bit; a group's values are in ascending sample order (rows of one sample by value). The generator's words are made
by whole arrays, so a task can pass over the draws of other tasks at little cost: the resamples of a group are dealt out
over `SHARES` tasks, each of which walks the stream to its own. A task holds the values of one group, eight bytes a
sample; groups have fewer than 2^32. Of a group no mean is kept but the resamples' (1,000).
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARES, AT_ONCE = 8, 1 << 18


def stable_seed(base: int, label: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{base}:{label}".encode()).digest()[:8], "big")


def linear_percentile(ordered: list[float], q: float) -> float:
    """Linear interpolation between the neighbouring order statistics."""
    at = (len(ordered) - 1) * q
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def draws(seed: int, n: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).randrange(n) gives, call after call, in arrays: the leading bits of each word, those below n."""
    _, state, _ = random.Random(seed).getstate()
    generator = np.random.RandomState()
    generator.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    bits = n.bit_length()
    while True:
        words = np.frombuffer(generator.bytes(4 * AT_ONCE), "<u4") >> np.uint32(32 - bits)
        yield words[words < n]


def resampled_means(values: list[float], seed: int, first: int, end: int) -> list[float]:
    """Means of resamples `first` to `end` - 1, each of as many draws as there are values, summed in the order of the draws."""
    n, out = len(values), []
    held = np.zeros(0, dtype=np.uint32)
    x, skip = np.array(values), first * n
    for some in draws(seed, n):
        if skip >= len(some):
            skip -= len(some)
            continue
        held = np.concatenate([held, some[skip:]])
        skip = 0
        whole = min(len(held) // n, end - first - len(out))
        for row in held[: whole * n].reshape(whole, n):
            out.append(sum(x[row].tolist()) / n)
        held = held[whole * n :]
        if len(out) == end - first:
            return out


def interval(values: list[float], resamples: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    if len(values) == 1:
        return values[0], values[0]
    means = sorted(resampled_means(values, seed, 0, resamples))
    tail = round((1 - level) / 2, 12)
    return linear_percentile(means, tail), linear_percentile(means, 1 - tail)


def _percentile(ordered: Column, n: int, q: float) -> Column:
    at = (n - 1) * q
    low = F.get(ordered, int(at))
    return low + (F.get(ordered, min(int(at) + 1, n - 1)) - low) * F.lit(at - int(at))


def _name(c: str, kind: str) -> Column:
    """A key as Python writes it."""
    text = F.when(F.col(c), "True").otherwise("False") if kind == "boolean" else F.col(c).cast("string")
    return F.when(F.col(c).isNull(), "None").otherwise(text)


def intervals(df: DataFrame, by: list[str], values: list[str], order: str = "sample_id", resamples: int = 1000, seed: int = 20260906, level: float = 0.95) -> DataFrame:
    """by, n, and for each value its mean, <value>_ci_low and <value>_ci_high. Keys and value columns may have any names but those that end in an underscore here."""
    kinds = dict(df.dtypes)
    long = df.select(*by, order, F.explode(F.array(*[F.struct(F.lit(v).alias("value_"), F.col(v).cast("double").alias("x_")) for v in values])).alias("v_")).select(*by, order, "v_.*")
    groups = long.groupBy(*by, "value_").agg(F.array_sort(F.collect_list(F.struct(order, "x_"))).alias("l_"))
    size = -(-resamples // SHARES)
    names = F.array(*[_name(c, kinds[c]) for c in by]) if by else F.array().cast("array<string>")
    dealt = groups.select(*by, "value_", names.alias("names_"), F.transform("l_", lambda x: x["x_"]).alias("x_"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(size))).alias("first_"))
    dealt = dealt.repartition(F.xxhash64("names_", "value_", "first_"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for x, name, v, first in zip(b["x_"], b["names_"], b["value_"], b["first_"]):
                x = x.tolist()
                start = stable_seed(seed, f"{tuple(name)}:{v}")
                found.append([x[0]] * (min(first + size, resamples) - first) if len(x) == 1 else resampled_means(x, start, int(first), min(int(first) + size, resamples)))
            yield b[[*by, "value_"]].assign(n_=b["x_"].map(len), mean_=[sum(x.tolist()) / len(x) for x in b["x_"]], means_=found)

    schema = dealt.select(*by, "value_").schema.add("n_", "long").add("mean_", "double").add("means_", T.ArrayType(T.DoubleType()))
    means = dealt.mapInPandas(run, schema).groupBy(*by, "value_").agg(F.first("n_").alias("n_"), F.first("mean_").alias("mean_"), F.sort_array(F.flatten(F.collect_list("means_"))).alias("means_"))
    tail = round((1 - level) / 2, 12)
    ends = means.select(*by, "value_", "n_", "mean_", _percentile(F.col("means_"), resamples, tail).alias("low_"), _percentile(F.col("means_"), resamples, 1 - tail).alias("high_"))
    of = lambda v, c: F.max(F.when(F.col("value_") == v, F.col(c)))
    return ends.groupBy(*by).agg(F.max("n_").alias("n"), *[x for v in values for x in (of(v, "mean_").alias(f"{v}_mean"), of(v, "low_").alias(f"{v}_ci_low"), of(v, "high_").alias(f"{v}_ci_high"))])
