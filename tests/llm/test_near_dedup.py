import random
import re

import numpy as np
import pytest

from furlong.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, shingle=3, percent=85):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < shingle:
            return frozenset([tuple(words)]) if words else frozenset()
        return frozenset(tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1))

    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            linked = sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)
            if linked or rows[x][0] == rows[y][0]:
                root[find(x)] = find(y)
    groups = {}
    for x, (key, _) in enumerate(rows):
        groups.setdefault(find(x), []).append(key)
    return [(key, len(sets[x]), min(groups[find(x)])) for x, (key, _) in enumerate(rows)]


def corpus(seed):
    random.seed(seed)
    words = ["".join(random.choices("abcdefgÄé", k=4)) for _ in range(500)]
    rows = []
    for group in range(12):
        base = random.choices(words, k=random.choice([1, 2, 3, 20, 60, 120]))
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.randint(0, 2 + len(base) // 25)):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((len(rows) * 3 % 101, " ".join(copy) if random.random() < 0.5 else "\t ".join(w.upper() if w.isascii() else w for w in copy)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One  two"), (205, "one")]


@pytest.mark.parametrize(("seed", "like"), [(1, near_dedup.LIKE), (2, near_dedup.LIKE), (3, near_dedup.Likeness(5, 80, 96, 38))])
def test_equals_brute_force(documents, monkeypatch, seed, like):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)  # several tiles even here
    rows = corpus(seed)
    found = near_dedup.near_duplicates(documents(rows), like).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(
        (key, n, component if n else key) for key, n, component in brute(rows, like.shingle, like.percent)
    )
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_missing_ids_and_empty_tables(documents):
    docs = documents([(None, "a b c d e f"), (5, "a b c d e f"), (None, "x y z u v w"), (None, None)])
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert ("5", 4, 5, True) in rows and ("None", 4, 5, False) in rows
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_without_bias():
    random_ = np.random.default_rng(3)
    off = []
    for _ in range(60):
        whole = np.unique(random_.integers(0, 1 << 63, 300, np.uint64))
        left, right = np.sort(whole[:250]), np.sort(whole[50:])
        same = (near_dedup.signature(left) == near_dedup.signature(right)).mean()
        off.append(same - 200 / 300)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_null_ids_link_nothing_but_their_own_texts(documents):
    """Unrelated documents whose copies lack an id stay apart."""
    one, two, three = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    docs = documents([(1, one), (2, two), (None, one), (None, two), (None, three), (None, three), (None, "v w x y"), (3, None)])
    found = near_dedup.near_duplicates(docs).collect()
    named = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found if (r["component_id"] or 0) > 0}
    assert named == {(1, 5, 1, True), (2, 5, 2, True), (None, 5, 1, False), (None, 5, 2, False), (3, 0, 3, True)}
    others = sorted((r["n_shingles"], r["component_id"]) for r in found if r["component_id"] < 0 and r["kept"])
    assert [n for n, _ in others] == [2, 5, 5] and others[0][1] != others[1][1] == others[2][1]
    assert len(found) == 8


def test_all_texts_of_an_id_are_linked(documents):
    """One id with three texts, each of which a smaller id has too, and with none."""
    texts = ["a b c d e", "f g h i j", "k l m n o"]
    docs = documents([(5, texts[0]), (7, texts[1]), (9, texts[2]), *[(20, text) for text in texts], (20, ""), (30, "p q r s t")])
    found = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {(5, 5), (7, 5), (9, 5), (20, 5), (30, 30)}
