import hashlib
import random

from furlong.llm import mixing


def brute(rows):
    size = [len((text or "").encode().split()) for _, text, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    have = {s: sum(n for n, (*_, own) in zip(size, rows) if own == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left = sum(have.values()) - sum(target[s] for s in fixed)
        free = sum(weight[s] for s in names if s not in fixed)
        for s in names:
            if s not in fixed:
                target[s] = left * weight[s] / free
        over = [s for s in names if s not in fixed and target[s] >= 3 * have[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * have[s]
            fixed.add(s)
    taken = {}
    for s in names:
        own = sorted((hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest(), k or 0, n, i) for i, (n, (k, _, o)) in enumerate(zip(size, rows)) if o == s)
        goal, at = int(target[s]), 0
        for _, _, n, i in own:
            rounds, rest = divmod(goal, have[s]) if have[s] else (0, 0)
            taken[i] = rounds * n + max(0, min(at + n, rest) - at)
            at += n
    return [(n, have[s], target[s], taken[i]) for i, (n, (_, _, s)) in enumerate(zip(size, rows))]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(docs).collect())
    assert found == sorted((row[0], n, have, round(target, 6), taken) for row, (n, have, target, taken) in zip(rows, brute(rows)))
    return found


def test_equals_brute_force(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 60), random.choice(["a", "b", "ä", "z", None])) for i in range(300)]
    check(spark, rows)


def test_small_sources_stop_at_three_times(spark):
    rows = [(1, "one two", "a"), (2, "x " * 500, "b"), (3, None, "c"), (4, "y " * 300, "d"), (5, "z", "e")]
    found = check(spark, rows)
    assert all(taken <= 3 * n for _, n, _, _, taken in found)


def test_blocks_do_not_change_what_is_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SOURCE", 3)
    monkeypatch.setattr(mixing, "CHUNK", 4)
    check(spark, [(i, "w " * (i % 37), "abc"[i % 3]) for i in range(120)])


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(0, 5000), (1, 2000), (2, 1000), (3, 0)], "sid long, goal long")
    slots = mixing.schedule(goals, 1, 8200).filter("slot is not null").toPandas()
    for sid, share in ((0, 5 / 8), (1, 2 / 8), (2, 1 / 8)):
        own = slots[slots.sid == sid].sort_values("rank")
        assert own["rank"].tolist() == list(range(len(own)))
        assert abs((own["slot"] - own["rank"] / share).abs().max()) <= 12 / share
        assert own["slot"].is_monotonic_increasing


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_the_mixture_is_interleaved(spark):
    """Slots hold one block each, blocks have equal words, sources alternate, and the words are those of the streams."""
    random.seed(6)
    rows = [(i, " ".join(f"{i}.{k}" for k in range(random.randint(0, 50))), "abc"[i % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted((r.asDict() for r in mixing.mixture(docs)[0].collect()), key=lambda r: (r["place"], r["at"]))
    texts = {i: text.split() for i, text, _ in rows}
    blocks, streams = {}, {}
    for r in found:
        assert 0 <= r["from_word"] < r["to_word"] <= len(texts[r["doc_id"]])
        blocks.setdefault(r["place"], []).append(r)
    for place, own in blocks.items():
        assert len({(r["source"], r["rank"], r["slot"]) for r in own}) == 1 and own[0]["slot"] in (place, None)
    order = [own[0]["source"] for own in blocks.values()]
    sizes = [sum(r["to_word"] - r["from_word"] for r in own) for own in blocks.values()]
    last = {source: place for place, source in enumerate(order)}
    assert len({n for place, n in enumerate(sizes) if place not in last.values()}) == 1
    # Any long run of slots holds the sources by their weights.
    window = [order[at : at + 160] for at in range(0, len(order) // 2, 40)]
    assert all(abs(part.count("a") - 100) < 12 and abs(part.count("b") - 40) < 12 for part in window)
    for r in sorted(found, key=lambda r: (r["source"], r["at"])):
        streams.setdefault(r["source"], []).extend(texts[r["doc_id"]][r["from_word"] : r["to_word"]])
    for source, words in streams.items():
        own = sorted((i for i, _, s in rows if s == source), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        endless = [word for i in own for word in texts[i]] * 3
        assert words == endless[: len(words)]


def test_the_stage_emits_texts_in_the_order_of_the_schedule(spark):
    from furlong.llm import stages

    rows = [(i, " ".join(f"{i}.{k}" for k in range(i % 7 + 3)), "abc"[i % 3], 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = [(r["doc_id"], r["text"]) for r in stages.mixture(spark, docs, "").collect()]
    mixed = sorted((tuple(r) for r in mixing.mixture(docs)[0].select("place", "at", "doc_id", "from_word").collect()))
    assert [doc for doc, _ in found] == [doc for _, _, doc, start in mixed if start == 0]
    assert all(text for _, text in found)
