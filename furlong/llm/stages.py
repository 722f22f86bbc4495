"""The stages of the corpus pipeline: (name, function of (spark, docs, folder)).

Each works on all rows its predecessor kept; all but the last return the columns
of documents. Rows may repeat and ids may be null.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import language, mixing, near_dedup, substring_dedup
from furlong.llm.common import word_array
from furlong.llm.queries import TOKENIZER, crc, digests

# A text stays if one language has at least this share of its words.
LEAST_SHARE = 0.5
DOCUMENT = ("text", "lang", "source", "n_chars")


def own_names(stage):
    """Columns that are none of documents' get other names meanwhile, so that no name clashes inside a stage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        names = [name if name in ("doc_id", *DOCUMENT) else f"extra_{i}" for i, name in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), folder).select(names).toDF(*docs.columns)

    return run


@own_names
def languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts without letters and texts in which no language has half of the words."""
    model = language.fit(language.sample(docs.filter(crc(5) != 0)))
    return language.keep_identified(docs, model, LEAST_SHARE)


# Five words and a similarity of 0.8.
NEAR = near_dedup.Likeness(5, 80, 96, 38)


@own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the smallest id of each group, once. Rows without an id stay.

    Of several rows of a kept id the one with the smallest digest of its values stays, so reruns agree.
    """
    kept = near_dedup.near_duplicates(docs, NEAR).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    values = F.concat_ws(" ", *[F.coalesce(F.md5(F.col(name).cast("string").cast("binary")), F.lit("-")) for name in DOCUMENT if name in docs.columns])
    digest = F.md5(values.cast("binary"))
    several = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    named = named.join(kept, "doc_id", "left_semi").select(docs.columns)
    one = named.join(several, "doc_id", "left_anti").select(docs.columns)
    first = named.join(several, "doc_id", "left_semi").select("doc_id", digest.alias("d"), F.struct(*[F.col(name) for name in docs.columns]).alias("row"))
    named = one.unionByName(first.groupBy("doc_id").agg(F.min_by("row", "d").alias("row")).select("row.*"))
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


@own_names
def substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Takes out passages that a smaller id holds; texts of which nothing is left go."""
    return substring_dedup.without_repeats(docs)


@own_names
def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixed corpus: copies of documents as the blocks take them, in the order of the schedule.

    A copy of a document (a round of its source) stands where the block stands that takes its first word; what a
    later block takes of it follows it, so no text is cut at a block's edge. The last copy may end early, at the goal.
    """
    rows, _ = mixing.mixture(docs)
    first = F.min(F.struct("rank", "place", "at"))
    copies = rows.withColumn("m_begin", F.col("at") - F.col("from_word")).groupBy("sid", "m_begin")
    copies = copies.agg(first.alias("m_first"), F.max("to_word").alias("m_words"), F.first("doc_id").alias("m_id"), F.first("text_key").alias("m_key"), F.first("source").alias("m_source"))
    copies = copies.select("m_id", "m_key", "m_source", "m_words", F.col("m_first.place").alias("m_place"), F.col("m_first.at").alias("m_at"))
    texts = docs.withColumn("m_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "m_text_key", "source"])
    texts = texts.join(copies, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("m_text_key") == F.col("m_key")) & F.col("source").eqNullSafe(F.col("m_source")))
    words = word_array(F.col("text"))
    part = F.array_join(F.slice(words, F.lit(1), F.col("m_words").cast("int")), " ")
    texts = texts.withColumn("text", F.when(F.size(words) == F.col("m_words"), F.col("text")).otherwise(part))
    texts = texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts.orderBy("m_place", "m_at").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of every text; see bpe. The executors still hold what earlier stages took, so tables are small."""
    return digests(docs, public_tokenizers.path(TOKENIZER), pieces=200_000, moves=50_000)


STAGES = [
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]
