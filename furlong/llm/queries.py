"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bpe, chat, extraction, language, merkle, mixing, near_dedup, periodic_runs, quality, substring_dedup, topk, toxicity, url_filter
from furlong.llm.common import read, word_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark, folder):
    judged = quality.judge(read(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op2_chat_format(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added)))


def crc(remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainder


@query
def op3_language_id(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = F.coalesce(crc(5) == 0, F.lit(True))
    predicted = language.identify(docs, ~held_out)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_near_dedup(spark, folder):
    return near_dedup.near_duplicates(read(spark, folder, "documents"), near_dedup.LIKE)


@query
def op5_substring_dedup(spark, folder):
    cleaned = substring_dedup.remove_repeats(read(spark, folder, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return cleaned.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


@query
def op6_source_mixing(spark, folder):
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_html_extraction(spark, folder):
    extracted = extraction.extract(read(spark, folder, "pages"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def digests(docs: DataFrame, path: str, **tables: int) -> DataFrame:
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, **tables), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_byte_bpe(spark, folder):
    return digests(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op9_toxicity(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held_out = F.coalesce(crc(4) == 2, F.lit(True))
    scored = toxicity.score(docs, toxicity.learn(docs, labels, ~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_exact_top_k(spark, folder):
    return topk.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


# The list of the query's contract.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query
def op11_url_filter(spark, folder):
    return url_filter.judge(read(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def crc_of_id():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@query
def op12_merkle_manifest(spark, folder):
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    text = F.when(crc_of_id() % 3 == 0, lowered).otherwise(F.col("text"))
    rows = merkle.manifest(read(spark, folder, "documents"), {"text": text})
    rows = rows.withColumn("folded_root", merkle.fold(F.col("seen"), F.col("proof")))
    proof = merkle.digest(merkle.joined(F.col("proof"))).alias("proof_sha256")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified)


def planted_period(text):
    """Every tenth text repeats a stretch of its words from some word on; see the contract of the query."""
    words = word_array(text)
    number = F.floor(crc_of_id() / 10).cast("long")
    n = F.size("words").cast("long")
    first = number % n
    period = F.floor((n - first) / (3 + number % 8)).cast("long") + 1
    times = F.ceil((n - first) / period).cast("int")
    part = F.slice("words", (first + 1).cast("int"), period.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(part, times)), F.lit(1), (n - first).cast("int"))
    written = F.array_join(F.concat(F.slice("words", F.lit(1), first.cast("int")), again), " ")
    return words, F.when(F.size("words") > 0, written).otherwise(text)


@query
def op13_periodic_runs(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    words, written = planted_period(F.col("text"))
    chosen = F.coalesce(crc_of_id() % 10 == 0, F.lit(False))
    docs = docs.withColumn("words", F.when(chosen, words)).withColumn("text", F.when(chosen, written).otherwise(F.col("text")))
    rows = periodic_runs.find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    rows = rows.withColumn("longest", longest)
    length, period = F.col("longest.length"), F.col("longest.q")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
