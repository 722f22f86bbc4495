"""The Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from furlong.llm import merkle
from furlong.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout=8):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def path(levels, place, fanout=8):
    steps = []
    for nodes in levels[:-1]:
        run = place - place % fanout
        steps.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + fanout])))
        place //= fanout
    return steps


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of every row; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row)))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {name: tree([leaf for *_, leaf in sorted(groups[name])]) for name in names}
    top = tree([trees[name][-1][0] for name in names]) if names else []
    out = []
    for at, name in enumerate(names):
        for place, (named, key, leaf) in enumerate(sorted(groups[name])):
            out.append((key if named else None, leaf, trees[name][-1][0], top[-1][0], path(trees[name], place) + path(top, at)))
    return out


def plain(frame):
    rows = frame.select("doc_id", "leaf", "subroot", "root", "proof").collect()
    return [(*row[:4], [tuple(step) for step in row[4]]) for row in rows]


def docs_of(spark, rows):
    full = [(*row, "x", 1, "y") for row in rows]
    return spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, grid string")


@pytest.fixture
def low(monkeypatch):
    """Partitions of eight leaves, so that small tables need many rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {"a": 65, None: 3, "": 1, "é": 2}, {"a": 700, **{f"l{i}": 1 for i in range(20)}}])
def test_trees(spark, low, sizes):
    rows, key = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            key += 7
            rows.append((key * 31 % 100_003, "s", lang, key, f"text {key}"))
    found = merkle.manifest(docs_of(spark, rows))
    assert sorted(plain(found), key=str) == sorted(brute(rows), key=str)
    assert found.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "s", "en", 0, ""), (1, "s", "en", 0, ""), (1, "t", "en", 3, "abc"), (None, "s", "en", 1, "x")]
    rows += [(2, "s", "en", 1_000_000, "word " * 200_000)]
    assert sorted(plain(merkle.manifest(docs_of(spark, rows))), key=str) == sorted(brute(rows), key=str)
    assert merkle.manifest(docs_of(spark, rows).limit(0)).count() == 0


def test_exchange_gives_every_partition_its_proof(spark):
    for n in (1, 2, 8, 10, 65, 100):
        leaves = [sha(str(i)) for i in range(n)]
        nodes = spark.createDataFrame([(3, i, leaf) for i, leaf in enumerate(leaves)], "grid long, p long, node string")
        found = {row["p"]: (row["root"], [tuple(s) for s in row["above"]]) for row in merkle.exchange(nodes).collect()}
        levels = tree(leaves)
        assert found == {i: (levels[-1][0], path(levels, i)) for i in range(n)}


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    texts = {row[0]: row for row in rows}
    want = []
    for key, leaf, subroot, root, proof in brute(rows):
        row, found = texts[key], leaf
        if zlib.crc32(str(key).encode()) % 3 == 0 and row[4] is not None:
            found = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
        for left, right in proof:
            found = sha(left + found + right)
        want.append((key, leaf, subroot, root, sha("".join(a + b for a, b in proof)), found, found == root))
    got = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, small).collect()]
    assert sorted(got) == sorted(want)
    assert {row[-1] for row in got} == {True, False}
