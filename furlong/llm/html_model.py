"""A recurrent labeller of page blocks: bidirectional LSTM in numpy.

Each block is a bag of hashed features: the tags above it with the parts of
their classes and ids, pairs of neighbouring tags, its words, and a few sizes.
An LSTM reads a page's blocks forward and one backward, so every decision sees
the whole page. The model is trained here on pages laid out at random by
``practice``: article bodies and all kinds of surroundings under many names,
with words that mean nothing outside fixed phrases.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np

from furlong.llm.common import Bounded
from furlong.llm.html_blocks import OUTSIDE, Block, Node

TAGS, WORDS, SIZES = 4096, 2048, 8
INPUTS = TAGS + WORDS + SIZES
HIDDEN = 16
PAGES, EPOCHS, BATCH, RATE = 1100, 8, 32, 0.01
CELLS = 40_000

_WORD = re.compile(r"\w+")


@functools.lru_cache(maxsize=100_000)
def _place(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@functools.lru_cache(maxsize=20_000)
def _below(above: frozenset[int], last: str, name: str, tokens: tuple[str, ...]) -> tuple[frozenset[int], str]:
    """Features of a path that goes one tag further, and its last name; shared with the path above where it adds nothing."""
    own = {_place(f"c:{token}", TAGS) for token in tokens}
    if name not in ("html", "body"):
        own |= {_place(f"t:{name}", TAGS), _place(f"p:{last}>{name}", TAGS)}
        last = name
    return (above if own <= above else above | own), last


@functools.lru_cache(maxsize=20_000)
def _sorted(found: frozenset[int], last: str) -> tuple[int, ...]:
    return tuple(sorted(found | {_place(f"l:{last}", TAGS)}))


class Paths:
    """Features of the paths of one page, each made from the path above it."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[frozenset[int], str]] = {id(OUTSIDE): (frozenset(), "top")}

    def features(self, path: Node) -> tuple[int, ...]:
        asked = []
        while id(path) not in self.known:
            asked.append(path)
            path = path.above
        found = self.known[id(path)]
        for node in reversed(asked):
            found = self.known[id(node)] = _below(*found, node.name, node.tokens)
        return _sorted(*found)


# Where a block's features lie: words behind the tags, measures behind the words.
_word_places = Bounded(lambda word: TAGS + zlib.crc32(word.encode()) % WORDS, 100_000)
_MEASURES = range(TAGS + WORDS, INPUTS)


def features(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a page's blocks: block, feature, value."""
    feature: list[int] = []
    tagged, worded, sizes, linked, ended, stops = [], [], [], [], [], []
    paths, place = Paths(), _word_places.__getitem__
    for text, path, inside in page:
        tags = paths.features(path)
        found = set(map(place, _WORD.findall(text.lower())))
        feature += tags
        feature += found
        feature += _MEASURES
        tagged.append(len(tags))
        worded.append(len(found))
        sizes.append(len(text))
        linked.append(inside)
        ended.append(text[-1] in ".!?:;\"”»")
        stops.append(text.count(",") + text.count("."))
    count = len(page)
    words, size, number = np.array(worded), np.array(sizes), np.arange(count)
    measures = np.stack(
        [
            np.ones(count),
            np.log1p(size) / 5,
            np.minimum(1.0, np.array(linked) / size),
            np.array(ended, float),
            np.minimum(4, np.array(stops)) / 4,
            number == 0,
            number == count - 1,
            np.minimum(1.0, words / 12),
        ],
        1,
    )
    parts = np.stack([np.array(tagged), words, np.full(count, SIZES)], 1)
    weights = np.stack([np.ones(count), 1.0 / np.maximum(1.0, words) ** 0.5, np.zeros(count)], 1)
    value = np.repeat(weights.ravel(), parts.ravel()).astype(np.float32)
    ends = parts.sum(1).cumsum()
    value[ends[:, None] - SIZES + np.arange(SIZES)] = measures
    return np.repeat(number, parts.sum(1)), np.array(feature, np.int64), value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        width = 4 * HIDDEN
        self.parts = {
            "in": (random.normal(0, 0.05, (INPUTS, 2 * width + 1))).astype(np.float32),
            "forward": (random.normal(0, 0.2, (HIDDEN, width))).astype(np.float32),
            "backward": (random.normal(0, 0.2, (HIDDEN, width))).astype(np.float32),
            "out": (random.normal(0, 0.2, (2 * HIDDEN,))).astype(np.float32),
        }

    def _inputs(self, pages):
        """Input rows (pages, places, columns), mask, and the flat sparse features."""
        sizes = np.array([size for size, _ in pages])
        starts = np.cumsum(sizes) - sizes
        owner = np.concatenate([found[0] + start for (_, found), start in zip(pages, starts)])
        feature = np.concatenate([found[1] for _, found in pages])
        value = np.concatenate([found[2] for _, found in pages])
        rows = np.zeros((int(sizes.sum()), self.parts["in"].shape[1]), np.float32)
        # Features lie in order of their blocks, and every block has some.
        first = np.searchsorted(owner, np.arange(len(rows)))
        for low in range(0, len(rows), 4096):
            high = min(low + 4096, len(rows))
            a, b = first[low], first[high] if high < len(rows) else len(owner)
            rows[low:high] = np.add.reduceat(self.parts["in"][feature[a:b]] * value[a:b, None], first[low:high] - a)
        width = int(sizes.max())
        mask = np.arange(width)[None, :] < sizes[:, None]
        grid = np.zeros((len(pages), width, rows.shape[1]), np.float32)
        grid[mask] = rows
        return grid, mask, (owner, feature, value)

    @staticmethod
    def _scan(inputs, mask, recurrent, keep):
        """One direction; ``keep`` also returns what training needs."""
        n, width, _ = inputs.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        outputs, trace = np.zeros((n, width, HIDDEN), np.float32), []
        for t in range(width):
            z = inputs[:, t] + h @ recurrent
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            on = mask[:, t, None]
            if keep:
                trace.append((h, c, i, f, o, g, squashed, on))
            c = np.where(on, new_c, c)
            h = np.where(on, o * squashed, h)
            outputs[:, t] = h
        return outputs, trace

    @staticmethod
    def _scan_back(slopes, trace, recurrent):
        n, width, _ = slopes.shape
        d_in = np.zeros((n, width, 4 * HIDDEN), np.float32)
        d_recurrent = np.zeros_like(recurrent)
        dh = np.zeros((n, HIDDEN), np.float32)
        dc = np.zeros((n, HIDDEN), np.float32)
        for t in range(width - 1, -1, -1):
            h, c, i, f, o, g, squashed, on = trace[t]
            dh = dh + slopes[:, t]
            d_c = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), dh * squashed * o * (1 - o), d_c * i * (1 - g**2)], 1) * on
            d_in[:, t] = dz
            d_recurrent += h.T @ dz
            dh = np.where(on, dz @ recurrent.T, dh)
            dc = np.where(on, d_c * f, dc)
        return d_in, d_recurrent

    def _run(self, pages, keep=False):
        grid, mask, sparse = self._inputs(pages)
        width = 4 * HIDDEN
        forward, trace_f = self._scan(grid[:, :, :width], mask, self.parts["forward"], keep)
        backward, trace_b = self._scan(grid[:, ::-1, width : 2 * width], mask[:, ::-1], self.parts["backward"], keep)
        both = np.concatenate([forward, backward[:, ::-1]], 2)
        return both @ self.parts["out"] + grid[:, :, -1], mask, sparse, both, trace_f, trace_b

    def fit(self, pages, truth, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        means = {k: np.zeros_like(v) for k, v in self.parts.items()}
        squares = {k: np.zeros_like(v) for k, v in self.parts.items()}
        rounds, width = 0, 4 * HIDDEN
        for _ in range(EPOCHS):
            order = random.permutation(len(pages))
            for low in range(0, len(order), BATCH):
                chosen = order[low : low + BATCH]
                scores, mask, (owner, feature, value), both, trace_f, trace_b = self._run([pages[i] for i in chosen], True)
                right = np.zeros(scores.shape, np.float32)
                right[mask] = np.concatenate([truth[i] for i in chosen])
                error = np.where(mask, right - _sigmoid(scores), 0).astype(np.float32) / mask.sum()
                d_both = error[:, :, None] * self.parts["out"]
                in_f, d_forward = self._scan_back(d_both[:, :, :HIDDEN], trace_f, self.parts["forward"])
                in_b, d_backward = self._scan_back(d_both[:, ::-1, HIDDEN:], trace_b, self.parts["backward"])
                flat = np.concatenate([in_f[mask], in_b[:, ::-1][mask], error[mask][:, None]], 1)
                slopes = {"forward": d_forward, "backward": d_backward, "out": np.einsum("nt,nth->h", error, both)}
                sorted_features = np.argsort(feature, kind="stable")
                rows, first = np.unique(feature[sorted_features], return_index=True)
                slopes["in"] = np.zeros_like(self.parts["in"])
                slopes["in"][rows] = np.add.reduceat(flat[owner[sorted_features]] * value[sorted_features, None], first)
                rounds += 1
                for k, slope in slopes.items():
                    means[k] += 0.1 * (slope - means[k])
                    squares[k] += 0.01 * (slope * slope - squares[k])
                    self.parts[k] += RATE * (means[k] / (1 - 0.9**rounds)) / (np.sqrt(squares[k] / (1 - 0.99**rounds)) + 1e-7)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, the probability of every block to be main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, page in enumerate(pages) if page), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            at += 1
            while at < len(order) and (len(group) + 1) * len(pages[order[at]]) <= CELLS:
                group.append(order[at])
                at += 1
            scores, mask, *_ = self._run([(len(pages[i]), features(pages[i])) for i in group])
            for row, i in enumerate(group):
                out[i] = _sigmoid(scores[row][mask[row]])
        return out


# Names under which pages put their parts; words of surroundings. Made up for practice.
BODY = "content main main-content post-body entry-content article-body story text post entry page-content body-text primary blog-post".split()
AROUND = {
    "menu": "nav menu navbar main-menu topnav breadcrumb breadcrumbs tabs pagination toc".split(),
    "head": "header masthead top site-header branding logo topbar title-bar".split(),
    "foot": "footer site-footer bottom copyright colophon legal imprint".split(),
    "side": "sidebar aside widget related recommended most-read trending rail tags share social".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion commercial".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall banner-notice".split(),
    "form": "form search login signup contact feedback search-box".split(),
    "talk": "comments comment comment-list replies discussion responses thread disqus reader-comments".split(),
}
PHRASES = {
    "menu": "Home|News|About|Contact|Sport|Next|Previous|Archive|Products|Help".split("|"),
    "head": "Welcome|The Daily Page|Sign in|Your daily news|Skip to content".split("|"),
    "foot": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Powered by a site builder.".split("|"),
    "side": "Related stories|Most read|Share this|Follow us|Popular tags|Read more".split("|"),
    "ad": "Advertisement|Sponsored|Buy now and save!|Special offer|Shop the sale".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all|Subscribe to our newsletter|This site uses cookies.".split("|"),
    "form": "Your name|Email|Password|Send|Search|Submit|Log in".split("|"),
    "talk": "Reply|Comments|Posted by a reader|Leave a comment|Great article, thanks!".split("|"),
}
OUTER = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}


def practice(seed: int) -> tuple[str, list[bool]]:
    """A page laid out at random and, per block, whether it is main text."""
    random = np.random.default_rng(seed)
    out: list[str] = []
    truth: list[bool] = []
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéäñ"))

    def pick(items):
        return items[int(random.integers(len(items)))]

    def prose(low: int, high: int) -> str:
        codes = letters[random.integers(0, len(letters), int(random.integers(low, high)) * 6)]
        codes[random.integers(0, 6) :: 6] = " "
        codes[random.random(len(codes)) < 0.06] = " "
        text = ("a" + "".join(codes)).strip().capitalize()
        if random.random() < 0.3:
            text = text.replace(" ", pick([", ", " | ", "*** ", ". ", " &amp; "]), int(random.integers(1, 4)))
        return text + pick([".", ".", ".", "!", "?", ""])

    def leaf(tag: str, text: str, main: bool, link: bool = False) -> None:
        inner = f'<a href="/{len(out)}">{text}</a>' if link else text
        out.append(f"<{tag}>{inner}" + (f"</{tag}>" if random.random() < 0.9 or tag not in ("p", "li") else ""))
        truth.append(main)

    def around(kind: str, depth: int = 0) -> None:
        name = pick(AROUND[kind])
        real = kind in OUTER and random.random() < 0.6
        tag = OUTER[kind] if real else pick(["div", "div", "section", "ul" if kind == "menu" else "div"])
        marked = f' {pick(["class", "id"])}="{name}"' if not real or random.random() < 0.5 else ""
        out.append(f"<{tag}{marked}>")
        listed = kind in ("menu", "side") and random.random() < 0.7
        if listed and tag != "ul":
            out.append("<ul>")
        for _ in range(int(random.integers(1, 9 if kind in ("menu", "side", "talk") else 4))):
            text = pick(PHRASES[kind]) if random.random() < 0.45 else prose(1, 6) if kind in ("menu", "head", "form") else prose(2, 30)
            if listed:
                leaf("li", text, False, random.random() < 0.85)
            elif kind == "form":
                leaf(pick(["label", "p", "div"]) if random.random() < 0.7 else "legend", text, False)
                out.append("<input type=text><br>" if random.random() < 0.5 else "<hr>")
            else:
                leaf(pick(["p", "div", "span", "p"] if kind != "head" else ["h1", "div", "p", "span"]), text, False, random.random() < 0.3)
                out.append("<hr>" if random.random() < 0.1 else "<div></div>")
        if listed and tag != "ul":
            out.append("</ul>")
        out.append(f"</{tag}>")

    def article() -> None:
        tag = pick(["article", "article", "main", "div", "section"])
        name = pick(BODY) if random.random() < 0.85 else "".join(random.choice(letters[:26], 7))
        marked = f' {pick(["class", "class", "id"])}="{name}"' if tag in ("div", "section") or random.random() < 0.3 else ""
        out.append(f"<{tag}{marked}>")
        longest = 60 if random.random() < 0.85 else 4
        if random.random() < 0.85:
            inside = random.random() < 0.25
            out.append("<header>" if inside else "")
            leaf(pick(["h1", "h1", "h2"]), prose(2, 14), True)
            out.append("</header>" if inside else "")
        for _ in range(int(random.integers(1, 14 if random.random() < 0.88 else 90))):
            chance = random.random()
            if chance < 0.78:
                text = prose(1, longest)
                leaf("p", f"<b>{text}<br>" if random.random() < 0.1 else text, True)
            elif chance < 0.84:
                leaf(pick(["h2", "h3"]), prose(1, 8), True)
            elif chance < 0.88:
                out.append("<blockquote>")
                leaf("p", prose(5, 30), True)
                out.append("</blockquote>")
            elif chance < 0.92:
                out.append("<ul>")
                for _ in range(int(random.integers(1, 5))):
                    leaf("li", prose(2, 20), True, random.random() < 0.1)
                out.append("</ul>")
            elif chance < 0.94:
                out.append("<table><tr>")
                leaf("td", prose(1, 5), True)
                leaf("td", prose(1, 5), True)
                out.append("</tr></table>")
            elif chance < 0.96:
                out.append("<figure>")
                leaf("figcaption", prose(3, 15), True)
                out.append("</figure>")
            else:
                around(pick(["ad", "side", "notice", "form"]))
        if random.random() < 0.25:
            around("talk")
        out.append(f"</{tag}>")

    depth = int(random.integers(0, 3))
    out += ["<html><head><title>x</title></head><body>"] + [f'<div class="{pick(["wrapper", "container", "page", "row", "col", "site"])}">'] * depth
    for kind in ("notice", "head", "menu", "ad"):
        if random.random() < 0.55:
            around(kind)
    side = random.random() < 0.4
    if side and random.random() < 0.5:
        around("side")
        side = False
    if random.random() < 0.97:
        article()
    if side:
        around("side")
    for kind, chance in (("talk", 0.35), ("ad", 0.3), ("form", 0.25), ("notice", 0.2), ("foot", 0.75)):
        if random.random() < chance:
            around(kind)
    out += ["</div>"] * depth + ["</body></html>"]
    return "".join(out), truth
