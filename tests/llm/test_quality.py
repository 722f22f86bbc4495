import random
import re
from collections import Counter

from pyspark.sql import functions as F

from furlong.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, window in enumerate(windows) if seen[window] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(documents):
    random.seed(1)
    texts = [None, "", " \t\n ", "one", "a b c d e a b c d e", "x\x0by\x0cz\r\n\x85  q", "😀 # * | <>"]
    texts += ["\n".join(" ".join(random.choices("ab c é".split(), k=random.randint(0, 9))) for _ in range(12)) for _ in range(40)]
    texts.append(" ".join(random.choices("abcdefgh", k=30000)))
    rows = quality.counts(documents(list(enumerate(texts)))).collect()
    for row in rows:
        found = tuple(row[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert found == expected(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_buckets_are_close(spark):
    rows = spark.range(1, 200000, 37).select(F.col("id"), quality.bucket(F.col("id")).alias("b"))
    rows = rows.withColumn("low", quality.least_value(F.col("b"))).withColumn("next", quality.least_value(F.col("b") + 1))
    wrong = rows.filter("not (low <= id and id < next and (next - low) * 16 <= greatest(low, 16))")
    assert wrong.isEmpty()


def test_sketches_merge(documents):
    words = [f"w{i}" for i in range(60)]
    docs = documents([(i, " ".join(words[: 10 + i % 50])) for i in range(200)])
    measured = quality.measures(quality.counts(docs))
    parts = quality.sketches(measured.filter("doc_id % 2 = 0")).unionByName(quality.sketches(measured.filter("doc_id % 2 = 1")))
    merged = parts.groupBy("lang", "source", "measure", "b").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketches(measured).collect()))


def test_outliers_go_and_the_rest_stays(documents):
    random.seed(3)
    names = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(3000)]
    clean = [(i, " ".join(random.sample(names, random.randint(10, 200)))) for i in range(300)]
    junk = [(1000, " ".join(f"{w}###" for w in random.sample(names, 60))), (1001, "a b c"), (1002, "same old words again here " * 9)]
    kept = {row["doc_id"]: row["kept"] for row in quality.judge(documents(clean + junk)).collect()}
    assert [i for i, _ in clean if not kept[i]] == []
    assert [kept[i] for i, _ in junk] == [False] * 3


def test_nulls_and_empty_tables(documents):
    docs = documents([(1, None), (2, ""), (None, "word " * 20)], lang=None, source=None)
    assert [row["kept"] for row in quality.judge(docs).orderBy("doc_id").collect()][1:] == [False, False]
    assert quality.judge(docs.limit(0)).count() == 0
