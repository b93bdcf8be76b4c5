"""Quality rules with thresholds that adapt to each language and source.

Every document's signals are ratios of counts.  Per (language, source) and signal
a quantile sketch is kept: counts of logarithmic bins of 2 % relative width.  Such
sketches merge by adding counts, exactly and in any order.  A signal is bad above
its upper fence, q75 + ``FENCE`` times the interquartile range (at least the
signal's own ``least spread``); word length also has a lower fence.  Groups of
fewer than ``GROUP_ROWS`` documents use the merged sketch of their language, and
languages of fewer the one of all.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.arrays import bind
from quillgraph.llm.textkit import WORD, spread
from quillgraph.session import materialise

# The base rule.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\u000b\f\r"

GAMMA = 1.02
ZERO_BIN = -1_000_000
FENCE = 3.0
GROUP_ROWS = 100

#: Signal -> least spread taken for its fence.
SIGNALS = {"symbols": 0.05, "dup_lines": 0.2, "repeats": 0.15, "word_length": 0.8}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the row."""
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = bind(placed, lambda p: F.filter(p, lambda s, j: (
            F.coalesce(s["h"] == F.get(p, j + 1)["h"], F.lit(False))
            | ((j > 0) & F.coalesce(s["h"] == F.get(p, F.greatest(j - 1, F.lit(0)))["h"], F.lit(False))))))
        return F.size(F.array_distinct(F.flatten(F.transform(
            hits, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    def of(w: Column) -> Column:
        windows = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(windows, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return bind(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return of(words)


def _counts(text: Column) -> Column:
    """All counts of one text; the word and line arrays are built once."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    of_words = bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = bind(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), _without(text, SPACES).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"))


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and signals of every whole text; null counts as empty.

    Repeated rows are measured each by itself.  Windows are compared by 64-bit hashes
    of their three words, within one text only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fixed = docs.select("doc_id", "lang", "source", *keep, _counts(text).alias("_c"))
    c = F.col("_c")
    flat = fixed.select(
        "doc_id", "lang", "source", *keep, c["w"]["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
        c["n_symbols"].alias("n_symbols"), c["l"]["n_dup_lines"].alias("n_dup_lines"),
        c["w"]["n_repeat_words"].alias("n_repeat_words"), c["l"]["n_lines"].alias("_lines"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return flat.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))).withColumns({
            "symbols": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "_lines"),
            "repeats": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words"),
        }).drop("_lines")


def sketch_bins(measured: DataFrame) -> DataFrame:
    """The sketches: documents that pass the base rule, counted by language, source, signal and bin."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in SIGNALS])).alias("s")
    number = F.when(F.col("s.x") > 0, F.ceil(F.log("s.x") / math.log(GAMMA))).otherwise(F.lit(ZERO_BIN))
    return measured.filter(~F.col("base_failed")).select("lang", "source", each).groupBy(
        "lang", "source", F.col("s.signal").alias("signal"), number.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _levels(bins: DataFrame) -> DataFrame:
    """The sketches of (language, source), of each language and of all, merged by adding counts."""
    none = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    each = F.explode(F.array(group(2, F.col("lang"), F.col("source")), group(1, F.col("lang"), none), group(0, none, none))).alias("g")
    return bins.select(each, "signal", "bin", "n").groupBy("g.level", "g.lang", "g.source", "signal", "bin").agg(F.sum("n").alias("n"))


def fences(bins: DataFrame) -> DataFrame:
    """One row of thresholds per level, language and source: (level, lang, source, rows, f).

    A sketch has at most some thousand bins; its quartiles come from their running sum.
    """
    keys = ["level", "lang", "source"]
    # One shuffle by group serves the running sums and both groupings.
    merged = _levels(bins).repartition(*keys)
    sketch = Window.partitionBy(*keys, "signal")
    running = sketch.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    ranked = merged.withColumns({"_cum": F.sum("n").over(running), "rows": F.sum("n").over(sketch), "_v": value})
    at = lambda share: F.min(F.when(F.col("_cum") >= share * F.col("rows"), F.col("_v")))
    quartiles = ranked.groupBy(*keys, "signal").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    least = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])[F.col("signal")]
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    pick = lambda s, of: F.max(F.when(F.col("signal") == s, of))
    return quartiles.groupBy(*keys).agg(F.max("rows").alias("rows"), F.struct(
        *[pick(s, F.col("q3") + reach).alias(f"hi_{s}") for s in SIGNALS],
        pick("word_length", F.col("q1") - reach).alias("lo_word_length")).alias("f"))


def thresholds(bins: DataFrame) -> DataFrame:
    """The fences that hold for each (language, source): of the finest sketch with enough rows."""
    found = materialise(fences(bins))
    overall = found.filter("level = 0").select("f.*").first()   # one row of five numbers
    if overall is None:
        return found.select("lang", "source", "f")
    own = found.filter("level = 2").select("lang", "source", "rows", "f")
    lang = found.filter("level = 1").select(F.col("lang").alias("_lang"), F.col("rows").alias("_lang_rows"), F.col("f").alias("_lang_f"))
    least = F.struct(*[F.lit(overall[c]).alias(c) for c in overall.asDict()])
    return own.join(lang, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "lang", "source", F.when(F.col("rows") >= GROUP_ROWS, F.col("f"))
        .when(F.col("_lang_rows") >= GROUP_ROWS, F.col("_lang_f")).otherwise(least).alias("f"))


def apply_rules(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    A document is kept if the base rule passes and no signal lies outside its fences.
    Null languages and sources are groups of their own; an empty table gives no rows.
    """
    measured = materialise(measure(spread(docs), keep))
    limits = thresholds(sketch_bins(measured)).select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), "f")
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    outside = [F.col(s) > F.col(f"f.hi_{s}") for s in SIGNALS] + [F.col("word_length") < F.col("f.lo_word_length")]
    bad = F.coalesce(outside[0], F.lit(False))
    for test in outside[1:]:
        bad = bad | F.coalesce(test, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("f", "_l", "_s")
