"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets counts and four measures. Per language and source, the
measures of documents that pass the fixed base rule fill a log-linear sketch:
whole numbers below 32 have a bucket each, above that every power of two has 16
equal buckets, so a quantile is off by at most one part in 16. A sketch is a
table of bucket counts; two are merged by adding counts, in any order, with the
same result. Small groups (under ``LEAST`` documents) use the merged sketch of
their language, and that of all documents if the language is small too.

A document is kept if it passes the base rule and each of its measures lies
within fences of its group: the quartiles, moved out by ``REACH`` times the
distance between them and at least by a fixed ``SLACK``. Fences follow the group, and a
group without outliers loses nothing.

Only SQL functions are used. Nulls: a null text has no words and fails the base
rule; null languages and sources form groups of their own; repeated rows are
judged alike. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.llm.common import staged, word_array

WINDOW = 5
LEAST = 50
REACH = 4
# Measure: least distance of a fence from its quartile.
SLACK = {"word_length": 400, "symbol_share": 60, "line_share": 250, "repeat_share": 160}
TWO_SIDED = ("word_length",)


def _repeated(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more, all inside the row."""
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(sorted_pairs: Column) -> Column:
        same = F.filter(
            sorted_pairs,
            lambda x, i: F.coalesce(F.get(sorted_pairs, i - 1)["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(sorted_pairs, i + 1)["k"] == x["k"], F.lit(False)),
        )
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        steps = F.flatten(
            F.transform(
                F.array(places),
                lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            )
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(k: Column) -> Column:
        pairs = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        repeated = F.element_at(F.transform(F.array(pairs), covered), 1)
        return F.when(F.size(F.array_distinct(k)) < F.size(k), repeated).otherwise(0)

    return F.when(F.size(words) < WINDOW, 0).otherwise(F.element_at(F.transform(F.array(keys), count), 1)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every document."""
    text = F.coalesce("text", F.lit(""))
    with_words = docs.select("doc_id", "lang", "source", text.alias("text"), word_array(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return with_words.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x)), 1).cast("long").alias("n_lines"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def measures(counted: DataFrame) -> DataFrame:
    """Adds the base rule and the measures, in whole thousandths (word length in hundredths)."""

    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0).cast("long")

    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "word_length": share("word_chars", "n_words", 100),
            "symbol_share": share("n_symbols", "word_chars", 1000),
            "line_share": share("n_dup_lines", "n_lines", 1000),
            "repeat_share": share("n_repeat_words", "n_words", 1000),
        }
    )


def bucket(value: Column) -> Column:
    """Bucket of a whole number from 0 on."""
    power = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(16 * power + F.call_function("shiftright", value, power.cast("int")))


def least_value(number: Column) -> Column:
    """Smallest value of a bucket."""
    power = F.floor(number / 16) - 1
    return F.when(number < 32, number).otherwise(F.call_function("shiftleft", number - 16 * power, power.cast("int")))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket); adding them merges sketches."""
    entries = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("b")) for name in SLACK]))
    long = measured.filter(~F.col("base_failed")).select("lang", "source", entries.alias("e"))
    return long.groupBy("lang", "source", "e.measure", "e.b").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of each group of merged sketches and the fences around them, one row per group."""
    merged = sketch.groupBy(*by, "measure", "b").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "measure")
    ranked = merged.select(
        *by, "measure", "b", F.sum("n").over(group.orderBy("b")).alias("upto"), F.sum("n").over(group).alias("total")
    ).withColumn("value", least_value(F.col("b")))
    sides = []
    for name, slack in SLACK.items():
        here = F.col("measure") == name
        low = F.min(F.when(here & (4 * F.col("upto") >= F.col("total")), F.col("value")))
        high = F.min(F.when(here & (4 * F.col("upto") >= 3 * F.col("total")), F.col("value")))
        reach = F.greatest(REACH * (high - low), F.lit(slack))
        sides.append((high + reach).alias(f"{name}_most"))
        if name in TWO_SIDED:
            sides.append((low - reach).alias(f"{name}_least"))
    return ranked.groupBy(*by).agg(F.max("total").alias("size"), *sides)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per (lang, source), of the language or of all documents where a group is small."""
    own = _fences(sketch, ["lang", "source"])
    by_lang = _fences(sketch, ["lang"])
    whole = _fences(sketch.withColumn("everything", F.lit(1)), ["everything"])
    limits = [c for c in own.columns if c.endswith(("_most", "_least"))]
    own, by_lang, whole = own.alias("o"), by_lang.alias("l"), whole.alias("w")
    # The last join is with one row, the merged sketch of all documents.
    joined = own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang"))).join(whole, F.col("w.everything") == 1)
    return joined.select(
        "o.lang",
        "o.source",
        *[
            F.when(F.col("o.size") >= LEAST, F.col(f"o.{c}"))
            .when(F.col("l.size") >= LEAST, F.col(f"l.{c}"))
            .otherwise(F.col(f"w.{c}"))
            .alias(c)
            for c in limits
        ],
    )


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base rule, measures, fences and the verdict of every document."""
    measured = staged(measures(counts(docs)), "quality")
    limits = thresholds(sketches(measured)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    met = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    within = F.lit(True)
    for name in SLACK:
        within = within & (F.col(name) <= F.col(f"{name}_most"))
        if name in TWO_SIDED:
            within = within & (F.col(name) >= F.col(f"{name}_least"))
    # A group without a sketch has only documents that fail the base rule.
    return measured.join(limits, met, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
