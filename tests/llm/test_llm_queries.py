"""Registered queries against their SQL counterparts, and the pipeline stage by stage."""

import hashlib
import struct

import pytest
from compare import compare, connect

import corpus_pipeline
from furlong.llm import bpe, language, stages
from furlong.llm.common import staged
from furlong.llm.oracle import ORACLES
from furlong.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, small, name):
    outcome, *_ = compare(spark, connect(small), small, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok")


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def plain(frame):
    return sorted(map(tuple, frame.select("doc_id", "text").collect()), key=str)


def test_pipeline(spark, small):
    """Every stage's rows follow from its predecessor's by a plain loop; the whole run gives the last stage's rows."""
    from test_mixing import brute as mixed
    from test_near_dedup import brute as grouped
    from test_substring_dedup import brute as cleaned

    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = staged(stages.languages(spark, docs, small), "test")
    model = language.fit(language.sample(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")))
    tagger = language.Tagger(model)
    share = {t: tagger.tag([language.split(t)]).mean(0).max() if language.split(t) else 0 for _, t in plain(docs)}
    assert plain(first) == [row for row in plain(docs) if share[row[1]] >= 0.5]

    second = staged(stages.near_duplicates(spark, first, small), "test")
    rows = plain(first)
    keep = {key for key, _, component in grouped(rows, 5, 80) if key == component}
    assert plain(second) == [row for row in rows if row[0] in keep]

    third = staged(stages.substrings(spark, second, small), "test")
    rows = plain(second)
    want = {int(key): (removed, text) for key, _, removed, text in cleaned(rows, 50)}
    expected = [(key, want[key][1] if want[key][0] else text) for key, text in rows if want[key][1] or not want[key][0]]
    assert plain(third) == sorted(expected, key=str)

    fourth = staged(stages.mixture(spark, third, small), "test")
    rows = [tuple(r) for r in third.select("doc_id", "text", "source").collect()]
    expected = []
    for (key, text, _), (size, _, _, taken) in zip(rows, mixed(rows)):
        if size:
            expected += [(key, text)] * (taken // size)
            if taken % size:
                expected.append((key, b" ".join(text.encode().split()[: taken % size]).decode()))
    assert plain(fourth) == sorted(expected, key=str)

    path, pattern = stages.public_tokenizers.path(stages.TOKENIZER), stages.public_tokenizers.PATTERN
    out = []
    for key, text in plain(fourth):
        ids = bpe.encode_text(text, path, pattern)
        out.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert struct.calcsize("<I") == 4
    found = corpus_pipeline.run(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(out)


def test_stages_take_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "some words here"), (3, "some words here"), (3, "some words here"), (4, "x")])
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for name, stage in stages.STAGES:
            rows = staged(stage(spark, rows, ""), "test")
            assert name == stages.STAGES[-1][0] or rows.columns == docs.columns


def test_stages_keep_clashing_columns(spark, documents):
    """Columns under the names the stages use themselves come through every stage with their values."""
    words = [f"word{i}" for i in range(40)]
    docs = documents([(i, " ".join(words[i:] + ["the", "and", "of"] * 4)) for i in range(6)])
    names = ["__key", "__doc", "__tkey", "__maybe", "m_id", "m_key", "m_text_key", "d", "row", "extra_0"]
    for nth, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id * 100 + nth)
    rows = docs
    for _, stage in stages.STAGES[:-1]:
        rows = staged(stage(spark, rows, ""), "test")
        assert rows.columns == docs.columns
        assert all(r[name] == r["doc_id"] * 100 + nth for r in rows.collect() for nth, name in enumerate(names))
    assert rows.count() > 0


def test_of_several_texts_of_an_id_the_same_one_stays(spark, documents):
    texts = [(1, f"text number {i} " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(5)]
    kept = {plain(stages.near_duplicates(spark, documents(rows), ""))[0] for rows in (texts, texts[::-1], texts + texts)}
    assert len(kept) == 1


def test_operators_do_not_delete_each_others_tables(spark, documents):
    """Two operators at work in one driver: what one stages outlives the other."""
    from furlong.llm import mixing, near_dedup
    from furlong.llm.common import Scope

    docs = documents([(i, f"some words number {i}") for i in range(8)])
    rows, placed = mixing.mixture(docs, Scope())
    near_dedup.near_duplicates(docs).count()
    assert placed.count() == 8 and rows.count() > 0
