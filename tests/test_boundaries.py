"""Trained sentence boundaries against a plain implementation of the published statistics and decisions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from visiloom.operators import boundaries, objective


def corpus():
    rng = random.Random(11)
    nouns, verbs = ["river", "engine", "paper", "result", "sample", "village"], ["shows", "holds", "moves", "gives"]
    out = []
    for i in range(160):
        text = []
        for _ in range(rng.randint(2, 7)):
            subject = rng.choice(["The", "A", "However, the", "It is said that the"]) + " " + rng.choice(nouns)
            middle = rng.choice(["", " by Dr. Miller", " of Prof. Brown", ", e.g. the " + rng.choice(nouns) + ",", " (approx. 5. May 1990)", " of J. Smith", " in No. 7", " at St. Moritz"])
            text.append(f"{subject} {rng.choice(verbs)} the {rng.choice(nouns)}{middle} [{rng.randint(1, 4)}]" + rng.choice([".", ".", ".", "!", "?", "...", '."', ".)"]))
        out.append((rng.choice([" ", "  ", "\n", "\n\n", "\t"])).join(text))
    return out + ["", " \n ", "...", "- . -", "No. ", "U.S.A. is big. u.s.a. is small.", "Été. ÉTÉ. été", "1. One 2. two 3. Three", "x" * 50_000 + ". The end.", "a. b. c. D. e", out[0], out[1]]


def chunk(c):
    bare = re.sub(r"\[\d+\]", "", c)
    rest = re.sub(r"^[\W_]+", "", bare)
    tail = re.search(r"[\W_]*$", rest or bare)[0]
    core = re.sub(r"[\W_]+$", "", rest)
    word = "##number##" if re.fullmatch(r"\d[\d.,:]*", core) else core.lower()
    mark = "strong" if re.search("[!?。！？]", tail) else "dots" if re.fullmatch(r"[^.,;:]*\.\.+[^.,;:]*", tail) else "stop" if re.fullmatch(r"[^.,;:]*\.[^.,;:]*", tail) else "none"
    return word, mark, "upper" if core[:1].isupper() else "lower" if core[:1].islower() else "none", len(core) == 1 and core.isalpha(), c


def paragraphs(text):
    return [[chunk(c) for c in re.split(r"[ \t\n\x0b\f\r]+", p) if c] for p in re.split(r"\n[ \t]*\n", text)]


def log(x):
    return math.log(max(x, 1e-300))


def association(a, b, both, n):
    def like(k, m, p):
        return k * log(p) + (m - k) * log(1 - p)

    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    inside = 0 if a == both or not 0 < p1 < 1 else like(both, a, p1)
    outside = 0 if b == both or not 0 < p2 < 1 else like(b - both, n - a, p2)
    return -2 * (like(both, a, p) + like(b - both, n - a, p) - inside - outside)


class Plain:
    def __init__(self, texts):
        runs = [p for t in texts for p in paragraphs(t) if p]
        n, stops = Counter(), Counter()
        for p in runs:
            for w, mark, *_ in p:
                if w:
                    n[w] += 1
                    stops[w] += mark == "stop"
        total, all_stops = sum(n.values()), sum(stops.values())
        self.abbreviations = {}
        for w, k in stops.items():
            if k and w != "##number##":
                rate, letters = all_stops / total, len(w.replace(".", ""))
                chance = k * log(rate) + (n[w] - k) * log(1 - rate)
                always = k * math.log(0.99) + (n[w] - k) * math.log(1 - 0.99)
                score = -2 * (chance - always) * math.exp(-letters) * (len(w) - letters + 1) * letters ** -(n[w] - k)
                if score >= 0.3:
                    self.abbreviations[w] = score
        breaks, at_break, pairs, self.seen = 0, Counter(), Counter(), defaultdict(set)
        for p in runs:
            for i, (w, _, case, _, _) in enumerate(p):
                left, mark, _, initial, _ = p[i - 1] if i else ("", "start", "", False, "")
                odd, abbreviation = (initial or left == "##number##") and mark in ("stop", "dots"), left in self.abbreviations
                end = mark == "strong" or mark == "stop" and not abbreviation
                breaks += end
                if end and not odd and re.fullmatch(r"[^\W\d_]+", w):
                    at_break[w] += 1
                if mark == "stop" and (abbreviation or odd) and w and left:
                    pairs[left, w] += 1
                open_ = mark == "dots" or mark == "stop" and (abbreviation or odd)
                self.seen[w].add((case, "begin" if mark == "start" or end and not odd else "open" if open_ else "within"))
        self.starters = {w for w, k in at_break.items() if association(breaks, n[w], k, total) >= 30 and total / breaks > n[w] / k}
        self.collocations = {(a, b) for (a, b), k in pairs.items() if k > 1 and n[a] > 1 and n[b] > 1 and k <= min(n[a], n[b]) and b not in self.starters and association(n[a], n[b], k, total) >= 7.88 and total / n[a] > n[b] / k}

    def ends(self, a, b):
        left, mark, _, initial, _ = a
        word, _, case, _, _ = b
        if mark in ("none", "strong"):
            return mark == "strong"
        seen = self.seen[word]
        capital, small = any(c == "upper" for c, _ in seen), any(c == "lower" for c, _ in seen)
        begins = None
        if not word:
            begins = False
        elif case == "upper" and small and ("upper", "within") not in seen:
            begins = True
        elif case == "lower" and (capital or ("lower", "begin") not in seen):
            begins = False
        abbreviation = mark == "dots" or left in self.abbreviations
        if (left, word) in self.collocations:
            return False
        if abbreviation and not initial and (begins or case == "upper" and word in self.starters):
            return True
        if (initial or left == "##number##") and begins is False:
            return False
        if initial and begins is None and case == "upper" and not small:
            return False
        return not abbreviation

    def sentences(self, text):
        out = []
        for p in paragraphs(text):
            for i, x in enumerate(p):
                if not i or self.ends(p[i - 1], x):
                    out.append([])
                out[-1].append(x[4])
        return [" ".join(s) for s in out]


@pytest.fixture(scope="module")
def model(spark):
    texts = corpus()
    df = spark.createDataFrame([(i % 150, t, "x") for i, t in enumerate(texts)] + [(0, None, "y")], "id int, text string, sentences string").repartition(3)
    pairs = boundaries.neighbours(df).cache()
    return texts, df, boundaries.fitted(pairs), Plain(texts)


def test_counts_and_model(model):
    _, _, m, plain = model
    got = {r.word: r.score for r in m.abbreviations.collect()}
    assert got.keys() == plain.abbreviations.keys() and all(math.isclose(got[w], plain.abbreviations[w], rel_tol=1e-9) for w in got)
    assert {"dr", "prof", "st", "e.g"} <= got.keys()
    assert {r.word for r in m.starters.collect()} == plain.starters and plain.starters
    assert {(r.left, r.word) for r in m.collocations.collect()} == plain.collocations and plain.collocations


def test_decisions(model):
    texts, df, m, plain = model
    got = m.sentences(df.drop("sentences")).select("text", "sentences").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.sentences == (None if r.text is None else plain.sentences(r.text)), r.text[:200]
    [found] = [r.sentences for r in got if r.text == "U.S.A. is big. u.s.a. is small."]
    assert len(found) == 2


def test_other_texts_and_no_corpus(spark, model):
    *_, m, plain = model
    new = ["The river moves. Dr. Miller holds the paper.", "Unseen abbr. Word follows."]
    other = spark.createDataFrame([(t,) for t in new], "t string")
    assert {r.t: r.s for r in m.sentences(other, "t", "s").collect()} == {t: plain.sentences(t) for t in new}
    empty = boundaries.fitted(boundaries.neighbours(other.where("false"), "t"))
    assert empty.abbreviations.count() == 0
    assert sorted(len(r.s) for r in empty.sentences(other, "t", "s").collect()) == [2, 3]


def test_scores_of_trained_sentences(spark, model):
    """A stop after an abbreviation no longer cuts a sentence off from its citation: all credit goes where it should."""
    *_, m, _ = model
    df = spark.createDataFrame([("The engine by Dr. Miller moves [2]. The paper by Prof. Brown holds [1].", 2)], "answer string, candidate_document_count int")
    found = objective.scored(m.sentences(df, "answer"), units=objective.units_of("sentences")).select("scores.raw.word", "scores.diagnostics.uncited_sentence_count").first()
    assert found.word == [5.0, 4.0] or found.word == [4.0, 4.0], found
    assert found.uncited_sentence_count == 0
    plain = objective.scored(df).select("scores.diagnostics.uncited_sentence_count").first()
    assert plain.uncited_sentence_count == 2


def test_patterns_of_a_chunk_are_bound(spark):
    """Each pattern is looked for once a chunk: what is used again is bound, not written out again."""
    made = spark.range(1).select(F.lit("(e.g.").alias("c")).select(boundaries._chunk(F.col("c"), F.lit(True), F.lit(True)).alias("x"))
    text = made._jdf.queryExecution().analyzed().toString().lower()
    assert text.count("regexp_") + text.count("rlike") <= 12


def test_patterns_read_distinct_pairs(model):
    """Patterns of chunks are looked for after chunks are counted, and no more once the places of marks are stored."""
    _, df, m, _ = model

    def plan(x):
        return x._jdf.queryExecution().optimizedPlan().toString().lower()

    other = df.select(F.upper("text").alias("text"))  # the pairs of df itself are cached
    of_pairs = plan(boundaries.neighbours(other))
    at_places = of_pairs[of_pairs.rindex("aggregate") :].split("- project", 1)[1]  # below the counting
    assert "regexp_extract(" in of_pairs and "regexp_extract(" not in at_places
    assert "regexp_extract(" not in plan(m.sentences(df.drop("sentences")))
