"""The URL filter against plain dictionaries of contexts."""

import bisect
import math
import random
import zlib
from collections import Counter

import pytest

from furlong.llm import url_filter
from furlong.llm.queries import QUERIES, URL_RULES
from furlong.llm.url_filter import FARTHEST, ORDER, Rule

PAGES = "page_id long, url string, html string, host string, verdict boolean, score string, row int"


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host) + len(r.path), default=None)


def places(url):
    text = b"\0" * ORDER + (url or "").encode() + b"\x01"
    return [text[i - ORDER : i + 1] for i in range(ORDER, len(text))]


class Model:
    def __init__(self, urls):
        self.grams, self.contexts, self.kinds = Counter(), Counter(), Counter()
        for url in urls:
            for gram in places(url):
                for k in range(ORDER + 1):
                    short = gram[ORDER - k :]
                    if not self.grams[short]:
                        self.kinds[short[:-1]] += 1
                    self.grams[short] += 1
                    self.contexts[short[:-1]] += 1

    def log(self, gram):
        p = 1 / 256
        for k in range(ORDER + 1):
            short = gram[ORDER - k :]
            n, t = self.contexts[short[:-1]], self.kinds[short[:-1]]
            if n:
                p = (self.grams[short] + t * p) / (n + t)
        return math.log(p)


def brute(urls, rules):
    """(host, path, rule, verdict) of every URL."""
    parts = [split(url) for url in urls]
    ruled = [rule_of(*part, rules) for part in parts]
    fold = [zlib.crc32((url or "").encode()) % 2 for url in urls]

    def models(keep):
        return [Model([u for i, u in enumerate(urls) if ruled[i] and ruled[i].verdict == v and keep(i)]) for v in ("allow", "block")]

    of = [models(lambda i: True), models(lambda i: fold[i] != 0), models(lambda i: fold[i] != 1)]

    def score(i):
        yes, no = of[1 + fold[i] if ruled[i] else 0]
        millionths = [math.floor((yes.log(g) - no.log(g)) * 1_000_000 + 0.5) for g in places(urls[i])]
        return max(-FARTHEST, min(FARTHEST, sum(millionths) // (1000 * len(millionths))))

    scores = [score(i) for i in range(len(urls))]
    kinds = [[s for s, r in zip(scores, ruled) if r and r.verdict == v] for v in ("allow", "block")]
    if all(kinds):
        def right(at):
            accepted = len(kinds[0]) - bisect.bisect_left(kinds[0], at)
            return len(kinds[1]) * accepted + len(kinds[0]) * bisect.bisect_left(kinds[1], at)

        kinds = [sorted(kind) for kind in kinds]
        least = min(range(-FARTHEST, FARTHEST + 1), key=lambda at: (-right(at), abs(at), at))
        verdicts = ["allow" if s >= least else "block" for s in scores]
    else:
        verdicts = ["block" if kinds[1] else "allow"] * len(urls)
    return [(*part, r and r.host + r.path, r.verdict if r else v) for part, r, v in zip(parts, ruled, verdicts)]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, url, "h", "x", True, "y", 3) for i, url in enumerate(urls)], PAGES)


def judged(spark, urls, rules):
    rows = url_filter.judge(pages_of(spark, urls), rules).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def made_up(n, seed=3):
    rng = random.Random(seed)
    words = ["news", "shop", "pills", "cheap", "blog", "wiki", "é", "a" * 9]
    ends = ["com", "net", "org", "COM", "co"]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}{rng.choice(words)}.{rng.choice(ends)}/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(1, 40)}{rng.choice(['', '?q=1', '#x'])}" for _ in range(n)]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_equals_brute_force(spark, monkeypatch, frequent):
    """Also when all or most n-grams are looked up by the join."""
    monkeypatch.setattr(url_filter.score, "__defaults__", (ORDER, frequent))
    urls = made_up(150) + [None, "", "no scheme", "://", "x://HOST", "http://example.com", "http://a.com:80/en/", "http://u@b.net/es/x"] + ["http://hot.net/fr/1"] * 60
    assert judged(spark, urls, URL_RULES) == brute(urls, URL_RULES)


def test_longest_rule_wins(spark):
    urls = ["https://Www.Example.com/en/1", "https://example.com/en/1", "https://m.example.com/en/1", "https://example.com/fr/1", "https://example.com", "https://notexample.com/en/", "http://a.net/es/?x", "http://a.net/ES/"]
    rules = [rule for _, _, rule, _ in judged(spark, urls, URL_RULES)]
    assert rules == ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", None, "com/", "net/es/", None]


def test_learns(spark):
    """Unruled hosts get the verdict of the URLs they look like."""
    rng = random.Random(1)
    good = [f"https://good{i}.com/articles/history-of-{rng.randint(0, 9)}" for i in range(120)]
    bad = [f"https://bad{i}.net/cheap/casino-bonus-{rng.randint(0, 9)}" for i in range(40)]
    asked = ["https://other.org/articles/history-of-7", "https://third.org/cheap/casino-bonus-9"]
    rules = [Rule("com", "/", "allow"), Rule("net", "/", "block")]
    found = judged(spark, good + bad + asked, rules)
    assert [row[3] for row in found[-2:]] == ["allow", "block"]
    assert {row[3] for row in judged(spark, bad + asked, rules)} == {"block"}
    assert {row[3] for row in judged(spark, asked, rules)} == {"allow"}


def test_long_and_empty(spark):
    urls = ["http://x.com/" + "a" * 300_000, "http://x.net/es/", "y" * 100_000, None]
    assert judged(spark, urls, URL_RULES) == brute(urls, URL_RULES)
    assert url_filter.judge(pages_of(spark, urls).limit(0), URL_RULES).count() == 0


def test_query_equals_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()
    want = [(page, *row) for (page, _), row in zip(pages, brute([url for _, url in pages], URL_RULES))]
    assert sorted(map(tuple, QUERIES["op11_url_filter"](spark, small).collect())) == sorted(want)
