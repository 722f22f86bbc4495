import os
import random

import numpy as np
import pyarrow as pa
import pytest

from furlong.llm import substring_dedup
from furlong.llm.common import map_batches
from furlong.llm.fm_index import FmIndex


def test_matching_statistics():
    random_ = np.random.default_rng(0)
    for trial in range(25):
        base = random_.integers(0, 4, 40)
        texts = []
        for k in range(6):
            text = random_.integers(0, 4 if trial % 2 else 2, random_.integers(1, 25))
            if k % 2:
                at = random_.integers(0, 20)
                text = np.concatenate([text, base[at : at + 15]])
            texts.append(text.astype(np.uint64) * 7)
        owners = random_.integers(0, 5, 6)
        found = FmIndex(texts, owners).matching_statistics(texts, owners)
        for text, owner, longest in zip(texts, owners, found):
            for i in range(len(text)):
                best = 0
                for other, whose in zip(texts, owners):
                    for j in range(len(other) if whose < owner else 0):
                        n = 0
                        while i + n < len(text) and j + n < len(other) and text[i + n] == other[j + n]:
                            n += 1
                        best = max(best, n)
                assert best == longest[i]


def brute(rows, size):
    first = {}
    split = [(text or "").encode().split() for _, text in rows]
    for (key, _), words in zip(rows, split):
        for p in range(len(words) - size + 1 if key is not None else 0):
            window = tuple(words[p : p + size])
            first[window] = min(key, first.get(window, key))
    out = []
    for (key, _), words in zip(rows, split):
        gone = set()
        for p in range(len(words) - size + 1 if key is not None else 0):
            if first[tuple(words[p : p + size])] < key:
                gone.update(range(p, p + size))
        out.append((str(key), len(words), len(gone), " ".join(w.decode() for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


def corpus(seed):
    random.seed(seed)
    names = ["".join(random.choices("abcdeé", k=5)) for _ in range(400)]
    passages = [random.choices(names, k=n) for n in (50, 51, 70, 130)] + [["la"] * 120, ["x", "y"] * 60, random.choices(names, k=49)]
    rows = []
    for i in range(60):
        words = random.choices(names, k=random.randint(0, 150))
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(words))
            words[at:at] = random.choice(passages)
        rows.append((i * 7 % 64, " ".join(words)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[5][1]), (102, "short one"), (103, "short one"), (104, None), (105, "")]
    rows += [(100, rows[3][1]), (None, rows[3][1]), (106, " ".join(passages[3] * 2))]
    return rows


@pytest.mark.parametrize("most", [1, 128])
def test_equals_brute_force(documents, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 700)
    rows = corpus(9)
    found = substring_dedup.remove_repeats(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == brute(rows, 50)


def test_rows_of_documents(documents):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, f"a  b {passage}"), (2, f"c {passage} d"), (3, passage), (4, "keeps  its\nspace"), (5, None)])
    found = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    assert sorted(found) == [1, 2, 4, 5]
    assert (found[2]["text"], found[2]["n_chars"], found[4]["text"], found[2]["taken"]) == ("c d", 3, "keeps  its\nspace", 7)


def test_empty_table(documents):
    assert substring_dedup.remove_repeats(documents([(1, "a")]).limit(0)).count() == 0


def test_idle_workers_hold_little(spark):
    def held():
        with open("/proc/self/statm") as sizes:
            return int(sizes.read().split()[1]) * 4096

    def step(batches):
        for _ in batches:
            # Small objects beside lasting ones: freeing them alone leaves the heap as large as it was.
            lasting, passing = [], []
            for n in range(400_000):
                (lasting if n % 64 == 0 else passing).append(np.full(64, n))
            most = held()
            del lasting, passing
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([most])], ["pid", "held"])

    def asked(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held()])], ["pid", "held"])

    one = spark.range(1).coalesce(1)
    before = map_batches(one, step, "pid long, held long").collect()[0]
    after = one.mapInArrow(asked, "pid long, held long").collect()[0]
    assert before["pid"] == after["pid"]
    assert after["held"] < before["held"] - (150 << 20)
