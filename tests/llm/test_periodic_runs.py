"""Periodic runs against a plain double loop."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from furlong.llm import periodic_runs
from furlong.llm.queries import QUERIES


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def kept(words, found):
    dropped = {i for start, length, period in found for i in range(start + period, start + length)}
    return b" ".join(word for i, word in enumerate(words) if i not in dropped)


def test_sums_are_exact():
    rng = np.random.default_rng(5)
    blocks, windows = rng.integers(0, 1 << 27, (7, 8)), rng.integers(0, 1 << 27, (7, 23))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(block, window[i:])) % periodic_runs.PRIME for i in range(16)] for block, window in zip(blocks, windows)]
    assert periodic_runs.squared_differences(blocks, windows).tolist() == want
    rows = rng.integers(0, periodic_runs.PRIME, (3, 64))
    assert (periodic_runs.restore(periodic_runs.transform(rows)) == rows).all()


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic_runs, "RESIDUES", rng.choice([1, 64, 1 << 17]))
    for _ in range(200):
        n, k = rng.randint(1, 150), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            start, period = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(start + period, rng.randint(start, n)):
                words[i] = words[i - period]
        assert periodic_runs.runs(np.array(words, np.int64)) == brute(words)


def test_long_texts():
    assert periodic_runs.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    piece = np.random.default_rng(1).integers(0, 5000, 30_000)
    words = np.concatenate([[6000], np.tile(piece, 7)[:200_000], [6001]])
    assert periodic_runs.runs(words) == [(1, 200_000, 30_000)]
    assert periodic_runs.runs(np.arange(300_000)) == []


def test_odd_rows(spark, documents):
    again = "a b c " * 6
    docs = documents([(1, None), (2, ""), (3, " \n"), (None, again), (4, again), (4, again), (5, "x"), (6, "k " * 11), (7, "é\u00a0b " * 12)])
    found = sorted(map(tuple, periodic_runs.find_runs(docs).collect()), key=str)
    run, one_word = [(0, 18, 3)], [(0, 12, 1)]
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 18, run, "a b c"), (4, 18, run, "a b c"), (4, 18, run, "a b c")]
    want += [(5, 1, [], "x"), (6, 11, [], "k " * 10 + "k"), (7, 12, one_word, "é\u00a0b")]
    assert found == sorted(want, key=str)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, small):
    want = []
    for key, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(key).encode()), len(words)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((key, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, found)).hexdigest()))
    got = {row["doc_id"]: tuple(row) for row in QUERIES["op13_periodic_runs"](spark, small).collect()}
    assert [got[row[0]] for row in want] == want
    assert sum(row[1] > 0 for row in want) > 10
