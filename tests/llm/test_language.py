import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from furlong.llm import language


def brute(emit, starts, moves, first):
    """Posteriors by listing all label sequences of each chain."""
    out = []
    cuts = [*np.flatnonzero(starts).tolist(), len(emit)]
    for a, b in zip(cuts, cuts[1:]):
        total = np.zeros((b - a, emit.shape[1]))
        for path in itertools.product(range(emit.shape[1]), repeat=b - a):
            score = first[path[0]] + sum(moves[x, y] for x, y in zip(path, path[1:])) + sum(emit[a + i, x] for i, x in enumerate(path))
            for i, x in enumerate(path):
                total[i, x] += np.exp(score)
        out.append(total / total.sum(1, keepdims=True))
    return np.concatenate(out)


def test_forward_backward(monkeypatch):
    random_ = np.random.default_rng(2)
    emit = random_.normal(0, 2, (23, 3))
    starts = np.zeros(23, bool)
    starts[[0, 1, 7, 15]] = True
    moves, first = random_.normal(0, 1, (3, 3)), random_.normal(0, 1, 3)
    right = brute(emit, starts, moves, first)
    for block in (1, 2, 4, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert np.allclose(language.chain(emit, starts, moves, first), right)


def test_training_slopes_agree_with_the_chain():
    random_ = np.random.default_rng(5)
    emit, moves, first = random_.normal(0, 1, (2, 6, 3)), random_.normal(0, 1, (3, 3)), random_.normal(0, 1, 3)
    posterior, expected = language.pair_posteriors(emit, moves, first)
    starts = np.arange(12) % 6 == 0
    assert np.allclose(posterior.reshape(12, 3), brute(emit.reshape(12, 3), starts, moves, first))
    assert np.isclose(expected.sum(), 2 * 5)


def test_code_switches(spark):
    random.seed(1)
    one = ["".join(random.choices(["ba", "do", "ki"], k=3)) for _ in range(80)]
    two = ["".join(random.choices(["öst", "ün", "ärz"], k=2)) for _ in range(80)]
    passages = [("aa", random.sample(one, 30)) for _ in range(30)] + [("bb", random.sample(two, 30)) for _ in range(30)]
    model = language.fit(sorted(passages))
    mixed = " ".join(one[:12] + two[:9])
    row = language.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [(s["start"], s["words"], s["lang"]) for s in row["spans"]] == [(0, 12, "aa"), (12, 9, "bb")]
    assert row["lang_pred"] == "aa" and 0.5 < row["score"] < 0.7


def test_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = language.identify(docs, ~held).join(docs.filter(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() >= 0.95


def test_texts_without_letters(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "12 ² ½ !!"), (4, "good words"), (None, "good words")])
    model = language.fit([("en", ["good", "words"] * 5), ("xx", ["zuz", "qaq"] * 5)])
    found = {row["doc_id"]: row for row in language.predict(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert [found[i]["score"] for i in (1, 2, 3)] == [0.0] * 3
    assert language.predict(docs.limit(0), model).count() == 0
    nothing = language.identify(docs, F.lit(False)).collect()
    assert {row["lang_pred"] for row in nothing} == {"und"}


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [("aa", f"word number {'abcdefghijklmnop'[i]} and more") for i in range(16) for _ in range(30)]
    found = language.sample(spark.createDataFrame(rows, "lang string, text string"))
    assert len({tuple(words) for _, words in found}) == 16


def test_every_language_is_learned(spark):
    """More languages than 32, the last ones with the fewest rows."""
    random.seed(4)
    parts = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    rows = []
    for k in range(40):
        own = ["".join(random.choices(parts[k : k + 3], k=3)) + "xyzw"[k % 4] for _ in range(30)]
        rows += [(f"l{k:02}", " ".join(random.choices(own, k=40))) for _ in range(44 - k)]
    passages = language.sample(spark.createDataFrame(rows, "lang string, text string"))
    model = language.fit(passages)
    assert len(model.labels) == 40
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert sum(found[i] == lang for i, (lang, _) in enumerate(rows)) >= 0.95 * len(rows)
    assert all(found[i] == lang for i, (lang, _) in enumerate(rows) if lang == "l39")
