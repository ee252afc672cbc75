"""Sentence boundaries learnt from a corpus without labels, after Kiss and Strunk (2006), as aggregations and joins.

A full stop ends a sentence, marks an abbreviation, or both. Which words are abbreviations, which pairs of words hold
together across a stop, and which words like to begin sentences is read off log-likelihood ratios of counts:

* abbreviations: how much likelier a word's stops are under "always has one" than under the corpus's rate, weighed down by
  its length and by its occurrences without a stop, and up by the stops within it;
* sentence starters: words that follow certain sentence ends far oftener than chance;
* collocations: pairs around a stop after an abbreviation, a number or an initial that are far commoner than chance;
* spelling: whether a word begins with a capital or not, at certain beginnings and within sentences.

All counts come from one grouping of neighbours (`neighbours`), the only pass over the texts; the rest works on its
rows, one for each pair around a mark and one for each word and context without. A decision hangs only on the pair around the
mark, so it is made once for each distinct pair and joined to the places that have it. Of the model only three totals
reach the driver; nothing is broadcast by hint.

Texts are read whole. Chunks lie between white space; a chunk's word is what is left without citations like [3]
and without marks at either end. An empty line ends a sentence, as do ! and ?. Null texts have no sentences; equal
texts have equal sentences, whatever their rows' ids; an empty corpus gives an empty model, under which every stop ends a sentence.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import let
from ..sources.scratch import stored

# The published thresholds.
ABBREVIATION, STARTER, COLLOCATION, ALWAYS = 0.3, 30.0, 7.88, 0.99

BLANKS = r"[ \t\n\x0B\f\r]+"
NUMBER = "##number##"
MARKS = ".!?。！？"
PARAGRAPH = "\n"  # stands before a paragraph's first chunk; no chunk holds one


def _chunk(c: Column, *beside: Column) -> Column:
    """word, kind of mark, case, whether it is an initial or a number, and what stands beside it. Patterns take nearly all the time, so what is used twice is bound (let), and plain words, by far the most, need one pattern."""

    def of(rest: Column, tail: Column) -> Column:
        core = F.when(rest == "", "").otherwise(F.left(rest, F.length(rest) - F.length(tail)))
        return let(core, lambda core: made(tail, core))

    def made(tail: Column, core: Column) -> Column:
        number = core.rlike(r"^\p{N}[\p{N}.,:]*$")
        mark = F.when(tail == "", "none").when(tail.rlike(r"[!?。！？]"), "strong").when(tail.rlike(r"^[^.,;:]*\.\.+[^.,;:]*$"), "dots").when(tail.rlike(r"^[^.,;:]*\.[^.,;:]*$"), "stop").otherwise("none")
        case = F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower").otherwise("none")
        return parts(F.when(number, NUMBER).otherwise(F.lower(core)), mark, case, core.rlike(r"^\p{L}$"))

    def parts(word: Column, mark: Column, case: Column, initial: Column) -> Column:
        return F.struct(word.alias("word"), mark.alias("mark"), case.alias("case"), initial.alias("initial"), *beside)

    def trimmed(bare: Column, rest: Column) -> Column:
        return let(F.regexp_extract(F.when(rest == "", bare).otherwise(rest), r"[^\p{L}\p{N}]*$", 0), lambda tail: of(rest, tail))

    bare = F.when(F.contains(c, F.lit("[")), F.regexp_replace(c, r"\[\p{N}+\]", "")).otherwise(c)
    full = let(bare, lambda bare: let(F.regexp_replace(bare, r"^[^\p{L}\p{N}]+", ""), lambda rest: trimmed(bare, rest)))
    plain = parts(F.lower(F.rtrim(c, F.lit(".,"))), F.when(F.endswith(c, F.lit(".")), "stop").otherwise("none"), F.lit("lower"), F.lit(False))
    return F.when(c.rlike(r"^\p{Ll}{2,}[.,]?\z"), plain).otherwise(full)


def _runs(text: Column) -> Column:
    """The chunks of a text in order, with PARAGRAPH before those of each paragraph."""
    return F.flatten(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.concat(F.array(F.lit(PARAGRAPH)), F.array_remove(F.split(p, BLANKS), ""))))


def _steps(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each chunk: what is kept of its text, at (its place in _runs), before (the chunk before it, or PARAGRAPH), chunk."""
    runs = texts.select(*keep, _runs(F.col(text)).alias("runs"))
    both = F.arrays_zip(F.col("runs").alias("before"), F.slice("runs", 2, F.size("runs")).alias("chunk"))
    rows = runs.select(*keep, F.posexplode(both).alias("at", "step")).select(*keep, (F.col("at") + 1).alias("at"), F.col("step")["before"].alias("before"), F.col("step")["chunk"].alias("chunk"))
    return rows.where(F.col("chunk").isNotNull() & (F.col("chunk") != PARAGRAPH))


def _may_end(chunk: str) -> Column:
    """Whether a chunk holds a mark; without one it is never dots, a stop or strong."""
    return functools.reduce(Column.__or__, [F.contains(chunk, F.lit(m)) for m in MARKS])


def _spread(texts: DataFrame) -> DataFrame:
    """The same rows, dealt out evenly: a file may keep nearly all texts in one row group, which one task would read."""
    return texts.hint("rebalance")


def neighbours(texts: DataFrame, text: str = "text") -> DataFrame:
    """mark (start, none, strong, dots or stop: what stands before), left and initial (the word before a stop or dots), word, case, stop (whether the word has one), n."""
    steps = _steps(_spread(texts.select(text)), text)
    before = F.when((F.col("before") == PARAGRAPH) | _may_end("before"), F.col("before")).otherwise("")
    # counted as they stand: patterns then read each distinct pair once, not each place
    counted = steps.select(before.alias("before"), "chunk").groupBy("before", "chunk").agg(F.count("*").alias("n"))
    read = counted.select("n", "before", _chunk(F.col("chunk")).alias("x"), F.when(~F.col("before").isin("", PARAGRAPH), _chunk(F.col("before"))).alias("b"))
    mark = F.when(F.col("before") == PARAGRAPH, "start").otherwise(F.coalesce("b.mark", F.lit("none")))
    marked = mark.isin("stop", "dots")
    pairs = read.select(mark.alias("mark"), F.when(marked, F.col("b.word")).alias("left"), F.when(marked, F.col("b.initial")).alias("initial"), "x.word", "x.case", (F.col("x.mark") == "stop").alias("stop"), "n")
    return pairs.groupBy(*[c for c in pairs.columns if c != "n"]).agg(F.sum("n").alias("n"))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def abbreviation_score(n: Column, with_stop: Column, stops: Column, words: Column, word: Column) -> Column:
    """n, with_stop: occurrences of the word, and those with a stop; stops, words: of the whole corpus."""
    rate = F.try_divide(stops, words)
    chance = with_stop * _log(rate) + (n - with_stop) * _log(1 - rate)
    always = with_stop * F.log(F.lit(ALWAYS)) + (n - with_stop) * F.log(F.lit(1 - ALWAYS))
    letters = F.length(F.regexp_replace(word, r"\.", ""))
    inner = F.length(word) - letters + 1
    return -2 * (chance - always) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -(n - with_stop).cast("double"))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events that occur a and b times, together `both` times, among n."""

    def likelihood(hits: Column, tries: Column, p: Column) -> Column:
        return hits * _log(p) + (tries - hits) * _log(1 - p)

    p, p1, p2 = F.try_divide(b, n), F.try_divide(both, a), F.try_divide(b - both, n - a)
    inside = F.when((a == both) | (p1 <= 0) | (p1 >= 1), 0.0).otherwise(likelihood(both, a, p1))
    outside = F.when((b == both) | (p2 <= 0) | (p2 >= 1), 0.0).otherwise(likelihood(b - both, n - a, p2))
    return -2 * (likelihood(both, a, p) + likelihood(b - both, n - a, p) - inside - outside)


@dataclass
class Boundaries:
    """abbreviations: word, score. starters: word. collocations: left, word. spelling: word, and how often in capitals or not, at certain beginnings or within."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    spelling: DataFrame

    def decided(self, pairs: DataFrame) -> DataFrame:
        """pairs (mark, left, initial, word, case; distinct) with ends: whether a sentence ends between left and word."""
        known = F.lit(True).alias("known")
        x = pairs.join(self.abbreviations.select(F.col("word").alias("left"), known).withColumnRenamed("known", "abbreviation"), "left", "left")
        x = x.join(self.collocations.select("left", "word", F.lit(True).alias("together")), ["left", "word"], "left")
        x = x.join(self.starters.select("word", F.lit(True).alias("starter")), "word", "left").join(self.spelling, "word", "left")
        no = F.lit(False)
        flag = lambda c: F.coalesce(F.col(c), no)
        many = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
        upper, lower = F.col("case") == "upper", F.col("case") == "lower"
        capitals, small = many("upper_begin") | many("upper_within") | many("upper_open"), many("lower_begin") | many("lower_within") | many("lower_open")
        begins = F.when(F.col("word") == "", no).when(upper & small & ~many("upper_within"), True).when(lower & (capitals | ~many("lower_begin")), False)
        short = flag("initial") | (F.col("left") == NUMBER)
        abbreviated = flag("abbreviation") | (F.col("mark") == "dots")
        first = ~abbreviated  # what the stop would be on its own
        likely = F.coalesce(begins, no) | (upper & flag("starter"))
        ends = (
            F.when(flag("together"), False)
            .when(abbreviated & ~flag("initial") & likely, True)
            .when(short & ~F.coalesce(begins, F.lit(True)), False)
            .when(flag("initial") & begins.isNull() & upper & ~small, False)
            .otherwise(first)
        )
        return x.select(*pairs.columns, ends.alias("ends"))

    def sentences(self, texts: DataFrame, text: str = "text", name: str = "sentences") -> DataFrame:
        """texts with an array of sentences, their chunks joined by single spaces; null where the text is."""
        row, at = "row_", "at"
        kept = stored(_spread(texts).withColumn(row, F.monotonically_increasing_id()), "texts")
        # exploded, so that the filter on the mark doesn't read the patterns a second time
        steps = _steps(kept, text, row).where(_may_end("before")).select(row, at, "chunk", F.explode(F.array(_chunk(F.col("before")))).alias("b"))
        places = stored(steps.where("b.mark <> 'none'").select(row, at, "chunk", "b.mark", F.col("b.word").alias("left"), "b.initial"), "places")
        known = places.join(self.abbreviations.select(F.col("word").alias("left"), F.lit(True).alias("abbreviation")), "left", "left")
        # strong marks, and stops after words that are nothing else, end a sentence whatever follows; the rest is asked for
        sure = (F.col("mark") == "strong") | ((F.col("mark") == "stop") & F.col("abbreviation").isNull() & ~F.col("initial") & (F.col("left") != NUMBER))
        # stored, as the joins' filters would else read the patterns at all places, and twice
        asked = stored(known.where(~sure).select(row, at, "mark", "left", "initial", _chunk(F.col("chunk")).alias("x")).select(row, at, "mark", "left", "initial", "x.word", "x.case"), "asked")
        question = ["mark", "left", "initial", "word", "case"]
        decided = asked.join(self.decided(asked.select(*question).distinct()), question).where("ends").select(row, at)
        ends = known.where(sure).select(row, at).unionByName(decided).groupBy(row).agg(F.array_sort(F.collect_list(at)).alias("ends"))
        made = kept.join(ends, row, "left").withColumn("runs", _runs(F.col(text)))
        # a sentence begins where it was decided, and at each paragraph: sentences and paragraphs are joined by line ends, which no chunk holds
        cut = F.concat(F.array(F.lit(0)), F.coalesce("ends", F.array().cast("array<int>")))
        upto = F.concat(F.coalesce("ends", F.array().cast("array<int>")), F.array(F.size("runs")))
        joined = F.array_join(F.zip_with(cut, upto, lambda a, b: F.array_join(F.slice("runs", a + 1, b - a), " ")), "\n")
        found = F.array_remove(F.split(joined, " ?\n ?"), "")
        return made.withColumn(name, F.when(F.col(text).isNotNull(), found)).select(*texts.columns, name)


def fitted(pairs: DataFrame) -> Boundaries:
    """The model of a corpus from its neighbours(), which are read several times and so should be stored or cached."""
    words = pairs.where("word <> ''")
    total = words.agg(F.sum("n").alias("words"), F.sum(F.when(F.col("stop"), F.col("n"))).alias("stops")).first()
    n_words, n_stops = F.lit(total.words or 0), F.lit(total.stops or 0)
    types = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("with_stop"))
    scored = types.where((F.col("with_stop") > 0) & (F.col("word") != NUMBER)).withColumn("score", abbreviation_score(F.col("n"), F.col("with_stop"), n_stops, n_words, F.col("word")))
    abbreviations = stored(scored.where(F.col("score") >= ABBREVIATION).select("word", "score"), "abbreviations")
    known = abbreviations.select(F.col("word").alias("left"), F.lit(True).alias("abbreviation"))
    seen = pairs.join(known, "left", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))
    odd = F.coalesce("initial", F.lit(False)) | F.coalesce(F.col("left") == NUMBER, F.lit(False))
    end = (F.col("mark") == "strong") | ((F.col("mark") == "stop") & ~F.col("abbreviation"))
    seen = seen.withColumns({"end": end, "certain": (F.col("mark") == "start") | (end & ~odd), "open": ((F.col("mark") == "stop") & (F.col("abbreviation") | odd)) | (F.col("mark") == "dots")})

    def times(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0))

    # all that is asked of a word, from one reading of the pairs
    within = ~F.col("certain") & ~F.col("open")
    cases = [times((F.col("case") == k) & w).alias(f"{k}_{n}") for k in ("upper", "lower") for n, w in (("begin", F.col("certain")), ("within", within), ("open", F.col("open")))]
    uses = stored(seen.groupBy("word").agg(F.sum("n").alias("n"), times(F.col("end")).alias("ends"), times(F.col("end") & ~odd).alias("here"), *cases), "uses")

    breaks = F.lit(uses.agg(F.sum("ends")).first()[0] or 0)
    s = uses.where((F.col("here") > 0) & F.col("word").rlike(r"^\p{L}+$"))
    starters = s.where((association(breaks, F.col("n"), F.col("here"), n_words) >= STARTER) & (F.try_divide(n_words, breaks) > F.col("n") / F.col("here"))).select("word")

    together = seen.where((F.col("mark") == "stop") & (F.col("abbreviation") | odd) & (F.col("word") != "") & (F.col("left") != "")).groupBy("left", "word").agg(F.sum("n").alias("both"))
    c = together.where("both > 1").join(uses.select(F.col("word").alias("left"), F.col("n").alias("a")), "left").join(uses.select("word", F.col("n").alias("b")), "word").join(starters, "word", "left_anti")
    enough = (F.col("a") > 1) & (F.col("b") > 1) & (F.col("both") <= F.least("a", "b"))
    collocations = c.where(enough & (association(F.col("a"), F.col("b"), F.col("both"), n_words) >= COLLOCATION) & (n_words / F.col("a") > F.col("b") / F.col("both"))).select("left", "word")
    spelling = uses.where("word <> ''").select("word", *[f"{k}_{n}" for k in ("upper", "lower") for n in ("begin", "within", "open")])
    return Boundaries(abbreviations, starters, collocations, spelling)
