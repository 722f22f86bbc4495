"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is an endless stream: its documents in a shuffled order (by a
digest of the id), repeated, and cut into blocks of ``B`` words. Slot i of the
schedule has the golden-ratio point frac(i / phi), as a 32-bit integer; the
source whose share of the cumulative targets holds the point gets the slot. The
r-th slot of a source takes the r-th block of its stream. A source takes
exactly the whole words of its target: later slots are left out, and missing
ones, at most a few, are added at the end. Targets are at most ``REPEATS``
times a source's words, and so is what is taken of a document.

Ranks and offsets are found in two steps (sums of chunks, then inside a chunk),
so a source that holds most rows is spread over many tasks. Only the table of
sources, one row each, is ordered in one place.

Null texts have size 0 and are never taken. A null source is a source, last in
order. Documents of one id are ordered by size; equal rows are
interchangeable. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.llm.common import Scope, word_array

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 2048
SLOTS_PER_SOURCE = 1024
CHUNK = 4096
# The fractional part of the golden ratio times 2**32.
GOLDEN = 2654435769
BIN_BITS = 10


def sizes(docs: DataFrame) -> DataFrame:
    size = F.size(word_array(F.col("text"))).cast("long").alias("size")
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", size)


def targets(sized: DataFrame) -> DataFrame:
    """Per source: ``sid`` (place by code point, null last), ``source_size``, ``target``, ``goal`` (its whole words).

    Sources are filled by weight until their limit, those with the lowest limit
    per weight first; what they cannot take raises the level of the others.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    ratio = F.col("most") / F.col("weight")
    filling = W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", REPEATS * F.col("source_size"))
        .withColumn("ratio", ratio)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filling), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("left_weight"))
    )
    open_level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("ratio") <= F.col("level"), F.col("most").cast("double")).otherwise(F.col("weight") * open_level)
    rows = rows.withColumn("target", target).withColumn("goal", F.floor("target").cast("long"))
    return rows.select("sid", "source", "source_size", "target", "goal")


def schedule(goals: DataFrame, block: int, n_slots: int) -> DataFrame:
    """``sid``, ``rank``, ``slot``: the blocks that each slot takes; slots added at the end have none."""
    spark = goals.sparkSession
    upto = F.sum("goal").over(W.orderBy("sid"))
    all_goals = F.sum("goal").over(W.partitionBy())

    def edge(words: Column) -> Column:
        return F.floor(words / all_goals * float(1 << 32)).cast("long")

    shares = goals.filter("goal > 0").select("sid", "goal", edge(upto - F.col("goal")).alias("low"), edge(upto).alias("high"))
    shift = 32 - BIN_BITS
    bins = F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))
    shares = shares.filter("high > low").withColumn("bin", F.explode(bins))
    point = (F.col("id") % (1 << 31) * GOLDEN).bitwiseAND((1 << 32) - 1)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("bin", F.shiftright("u", shift))
    hits = slots.join(shares, "bin").filter("u >= low and u < high").select("sid", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("sid", "chunk", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("inside", inside).join(chunks, ["sid", "chunk"])
    ranked = ranked.select("sid", (F.col("before") + F.col("inside")).alias("rank"), "slot")
    needed = goals.select("sid", F.ceil(F.col("goal") / block).cast("long").alias("needed"))
    kept = ranked.join(needed, "sid").filter("rank < needed").select("sid", "rank", "slot")
    have = needed.join(kept.groupBy("sid").agg(F.count("*").alias("have")), "sid", "left")
    missing = have.withColumn("have", F.coalesce("have", F.lit(0))).filter("have < needed")
    added = missing.select("sid", F.explode(F.sequence("have", F.col("needed") - 1)).alias("rank"), F.lit(None).cast("long").alias("slot"))
    return kept.unionByName(added)


def offsets(sized: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``start``: the words of the source before the document in the shuffled order."""
    n_buckets = max(1, math.isqrt(n_docs))
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / float(1 << 32)).cast("long")
    rows = sized.withColumn("key", key).withColumn("bucket", bucket)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("sid", "bucket", before.alias("before"))
    order = W.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(order)).join(sums, ["sid", "bucket"])
    return rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("key", "bucket", "before", "upto")


def mixture(docs: DataFrame, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture, and every row of the documents with its place in the stream of its source.

    A row of the mixture is what one block takes of one round of a document:
    ``place`` (of the block; slots in order, then added blocks), ``slot`` (null for an added block),
    ``rank`` (of the block in its source), ``sid``, ``source``, ``start``, ``at`` (in the stream),
    ``doc_id``, ``text_key``, ``from_word`` and ``to_word`` (of the document, end exclusive).
    Ordered by ``place`` and ``at``, the rows are the mixed corpus. They are computed from the tables in ``scope``.
    """
    scope = scope or Scope()
    sized = scope.staged(sizes(docs), "sizes")
    goals = scope.staged(targets(sized), "targets")
    whole = sized.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    n_sources = max(1, goals.count())
    block = max(1, min(BLOCK, whole["words"] // (n_sources * SLOTS_PER_SOURCE)))
    n_slots = math.ceil(whole["words"] / block * 1.02) + 64

    numbered = sized.withColumnRenamed("source", "own").join(
        goals.withColumnRenamed("source", "of"), F.col("own").eqNullSafe(F.col("of"))
    )
    numbered = numbered.select("doc_id", "text_key", F.col("own").alias("source"), "size", "sid", "source_size", "target", "goal")
    placed = scope.staged(offsets(numbered, whole["docs"]), "offsets")

    pieces = placed.filter("size > 0").select("sid", "start", "size", "source_size", "goal", "source", "doc_id", "text_key", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("round"))
    pieces = pieces.withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
    pieces = pieces.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal"))).filter(F.col("from") < F.col("to"))
    first, last = F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)
    pieces = pieces.withColumn("rank", F.explode(F.sequence(first, last)))
    at, end = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    # Added blocks follow all slots, rank by rank and source by source.
    added = n_slots + F.col("rank") * n_sources + F.col("sid")
    rows = pieces.join(schedule(goals, block, n_slots), ["sid", "rank"])
    rows = rows.withColumn("at", at).withColumn("place", F.coalesce("slot", added))
    words = [(F.col("at") - F.col("from")).alias("from_word"), (end - F.col("from")).alias("to_word")]
    names = ["place", "slot", "rank", "sid", "source", "start", "at", "doc_id", "text_key"]
    return rows.select(*names, *words), placed


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``source``, ``size``, ``source_size``, ``target``, ``taken`` of every row.

    What is taken of a document is the sum of its rows in the mixture.
    """
    scope = Scope()
    rows, placed = mixture(docs, scope)
    taken = rows.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # A document with words has its place in the stream to itself.
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    filled = placed.filter("size > 0").join(taken, ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    names = ["doc_id", "text_key", "source", "size", "source_size", "target", "taken"]
    return scope.settled(filled.select(names).unionByName(empty.select(names)), "mixed")
