import math
import re
import time
import zlib

import numpy as np

from furlong.llm import extraction, html_model
from furlong.llm.html_blocks import blocks
from furlong.llm.html_model import INPUTS, SIZES, TAGS, WORDS, Paths, features, practice


def texts(page):
    return [block.text for block in blocks(page)]


def test_blocks_of_broken_pages():
    assert texts(None) == texts("") == texts("<!-- only --><script>var a='<p>x</p>'</script>") == []
    assert texts("<p>a<b>b</b>\n c<br>d<p>e &amp;&lt;&#233;<li>f<li>g") == ["ab c d", "e &<é", "f", "g"]
    assert texts("a < b <p title='x>y'>c</p></div></p>d<!-- open") == ["a < b", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table><title>no</title>") == ["1", "2", "3"]
    assert len(blocks("<div>" * 500 + "deep")) == 1


def test_practice_pages_it_has_not_seen():
    model, right, all_blocks = extraction.labeller(), 0, 0
    for seed in range(90_000, 90_150):
        page, truth = html_model.practice(seed)
        found = blocks(page)
        if found and len(found) == len(truth):
            labels = model.label([found])[0] >= 0.5
            right += sum(bool(a) == b for a, b in zip(labels, truth))
            all_blocks += len(truth)
    assert right / all_blocks > 0.98


def test_batches_do_not_change_labels():
    pages = [blocks(html_model.practice(seed)[0]) for seed in range(91_000, 91_020)]
    model = extraction.labeller()
    for page, label in zip(pages, model.label(pages)):
        alone = model.label([page])[0]
        assert abs(alone - label).max(initial=0) < 1e-4


def test_given_pages(spark, small):
    """Their articles are marked, so the right answer is known."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {row["page_id"]: row["text"] for row in extraction.extract(pages).collect()}
    for row in pages.collect():
        marked = [block.text for block in blocks(row["html"]) if any(node.name == "article" for node in block.path)]
        assert found[row["page_id"]] == "\n".join(marked)


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, None, 3), (None, "u", "", 4)], "page_id long, url string, html string, text int")
    assert {(r["page_id"], r["url"], r["text"]) for r in extraction.extract(rows).collect()} == {(1, None, ""), (None, "u", "")}
    assert extraction.extract(rows.limit(0)).count() == 0


def test_what_is_left_out_ends():
    """Self-closed and unclosed tags do not swallow the page; formulas and fallback texts are kept."""
    main = "<article><p>Main text.</p></article>"
    for tag in ('<svg class="i"/>', "<math/>", "<svg>", "<select><option>", "<object>", "<iframe src=x/>", "<iframe>", "<template>", "<noscript>"):
        assert texts(f"<body>{tag}{main}</body>")[-1] == "Main text.", tag
        assert texts(f"<body>{tag}{main}<svg><text>no</text></svg></body>")[-1] == "Main text.", tag
    assert texts("<p>Let <math><mi>x</mi></math> be <svg><svg/><text>no</text></svg>it") == ["Let x be it"]
    assert texts("<article><object data=x><p>Fallback.</p></object></article>") == ["Fallback."]
    assert [node.name for node in blocks("<article><object data=x><p>Fallback.</p></object></article>")[0].path] == ["article", "object", "p"]
    assert texts("<p>a<select><option>no</select>b<noscript><p>no</p></noscript><iframe>no</iframe><template><p>no</template>c") == ["abc"]
    assert texts("<script>var a='<p>x</p>'") == texts("<style><p>x") == texts("<textarea><p>x") == []


def seconds(page):
    started = time.perf_counter()
    found = blocks(page)
    if found:
        html_model.features(found)
    return found, time.perf_counter() - started


def test_hostile_pages_take_linear_time():
    """Quotes without an end, tags inside one paragraph, blocks that are never closed: a megabyte or more each."""
    found, took = seconds("<p>Text.</p><a title=" + "\"'" * 500_000)
    assert [block.text for block in found] == ["Text."] and took < 5
    found, took = seconds("<p>" + "<a \"" * 200_000 + "x")
    assert took < 5
    found, took = seconds("<p>" + "a<b>b</b> " * 200_000 + "</p>")
    assert len(found) == 1 and len(found[0].text) == 599_999 and took < 5
    found, took = seconds("<div>x" * 100_000)
    assert len(found) == 100_000 and took < 5
    assert len(list(found[-1].path)) == 100_000
    found, took = seconds("<table><tr><p><td>" + "<b>" * 50_000 + "<h1>x</h1>" * 50_000)
    assert len(found) == 50_000 and took < 5
    _, took = seconds("<svg " * 100_000 + "<template>" * 100_000 + "<iframe " * 100_000)
    assert took < 5


def test_pages_cut_off_inside_a_tag():
    assert texts("<p>a</p><div class=\"x") == texts("<p>a</p><div class='x' id=") == ["a"]
    assert texts("<p>a</p><script>var x = 1") == texts("<p>a</p><!-- b --") == ["a"]
    assert texts("<p>a b") == ["a b"] and texts("plain > text") == ["plain > text"]


def plain_lstm(inputs, recurrent):
    """One direction, cell by cell, with plain numbers."""
    size = len(recurrent)
    h, c, out = [0.0] * size, [0.0] * size, []
    for row in inputs:
        z = [row[j] + sum(h[i] * recurrent[i][j] for i in range(size)) for j in range(4 * size)]
        gates = [1 / (1 + math.exp(-value)) for value in z[: 3 * size]]
        c = [gates[size + k] * c[k] + gates[k] * math.tanh(z[3 * size + k]) for k in range(size)]
        h = [gates[2 * size + k] * math.tanh(c[k]) for k in range(size)]
        out.append(h)
    return out


def test_labels_are_those_of_a_plain_loop():
    model = html_model.Labeller(seed=11)
    parts = {name: value.tolist() for name, value in model.parts.items()}
    width = 4 * html_model.HIDDEN
    pages = [blocks(html_model.practice(seed)[0])[:12] for seed in (92_000, 92_001)]
    for page, found in zip(pages, model.label(pages)):
        rows = [[0.0] * (2 * width + 1) for _ in page]
        for owner, feature, value in zip(*(part.tolist() for part in html_model.features(page))):
            rows[owner] = [a + value * b for a, b in zip(rows[owner], parts["in"][feature])]
        forward = plain_lstm([row[:width] for row in rows], parts["forward"])
        backward = plain_lstm([row[width : 2 * width] for row in rows[::-1]], parts["backward"])[::-1]
        for row, ahead, back, p in zip(rows, forward, backward, found):
            score = sum(a * b for a, b in zip(ahead + back, parts["out"])) + row[-1]
            assert abs(1 / (1 + math.exp(-score)) - p) < 1e-4


def plain_features(page):
    """One number after the other."""
    owner, feature, value = [], [], []
    paths = Paths()
    for number, block in enumerate(page):
        tags = paths.features(block.path)
        found = {zlib.crc32(word.encode()) % WORDS for word in re.findall(r"\w+", block.text.lower())}
        size = len(block.text)
        measures = (
            1.0, np.log1p(size) / 5, min(1.0, block.linked / size), float(block.text[-1] in ".!?:;\"”»"),
            min(4, block.text.count(",") + block.text.count(".")) / 4, float(number == 0), float(number == len(page) - 1),
            min(1.0, len(found) / 12),
        )
        weight = 1.0 / max(1.0, len(found)) ** 0.5
        owner += [number] * (len(tags) + len(found) + SIZES)
        feature += [*tags, *sorted(TAGS + word for word in found), *range(TAGS + WORDS, INPUTS)]
        value += [1.0] * len(tags) + [weight] * len(found) + list(measures)
    return np.array(owner, np.int64), np.array(feature, np.int64), np.array(value, np.float32)


def test_features_are_the_plain_ones_in_less_time():
    pages = [found for seed in range(300) if (found := blocks(practice(seed)[0]))]

    def timed(make):
        start = time.process_time()
        made = [make(page) for page in pages]
        return made, time.process_time() - start

    for (owner, feature, value), (owner_, feature_, value_) in zip(timed(features)[0], timed(plain_features)[0]):
        order, order_ = (np.lexsort((f, o)) for o, f in ((owner, feature), (owner_, feature_)))
        assert (owner == owner_).all() and (feature[order] == feature_[order_]).all()
        assert np.array_equal(value[order], value_[order_])
    assert min(timed(features)[1] for _ in range(5)) < 0.8 * min(timed(plain_features)[1] for _ in range(5))
