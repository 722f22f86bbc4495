"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters, in lower case. Its features are hashed character
n-grams (two and three letters), affixes (up to four letters at either end) and
an entry of a lexicon: the language in which the word is most frequent, by how
clearly it is. Transitions between the labels of neighbouring words are
learned with the rest. Training texts have one language each, so training
sequences are spliced from passages of several; the model learns both how words
look and how rarely the language changes.

Learning reads a bounded sample (``SAMPLE`` documents per language, ``PASSAGES``
passages of ``PASSAGE`` words from each, spread over the text) of every
language there is. Prediction reads every word of every text: all words of
a batch form one chain that restarts at each document. Forward-backward runs
over blocks of the chain at once - first the product of each block's steps,
then the blocks in order, then inside all blocks - which is exact and takes
texts of any length.

A document's language is the label with the largest summed posterior, the score
its share. Texts that are null or have no letter get ``und`` and score 0; so
does everything if there is nothing to learn from. Ties go to the smaller
label. Repeated rows are predicted alike. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.llm.common import map_batches

UNKNOWN = "und"
SAMPLE = 300
PASSAGE, PASSAGES = 40, 4
FEATURES = 1 << 16
LEXICON = 20_000
SEQUENCE, SEQUENCES = 60, 1600
# With more labels than this, training sequences grow with the labels.
LABELS = 32
EPOCHS, BATCH, RATE = 5, 80, 0.05
BLOCK = 64
VOCABULARY = 300_000
GROUP = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def split(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if found and not any(c.isalpha() for word in found for c in word):
        return []  # digits of other kinds only
    return found


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram and affix features of words: (word number, feature)."""
    text = " " + " ".join(vocabulary) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == 32
    number = np.cumsum(edge) - 1
    owners, features = [], []
    for n in (2, 3, 4, 5):
        if len(codes) < n:
            break
        count = len(codes) - n + 1
        inner = np.zeros(count, bool)
        for j in range(1, n - 1):
            inner |= edge[j : j + count]
        left, right = edge[:count], edge[n - 1 :]
        good = ~inner & ~(left & right) if n == 2 else ~inner
        if n > 3:
            good &= left | right  # longer ones as affixes only
        key = np.full(count, n, np.uint64)
        for j in range(n):
            key = (key ^ codes[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        at = np.flatnonzero(good)
        owners.append(number[at + 1] if n > 2 else np.where(edge[at + 1], number[at], number[at + 1]))
        features.append((key[at] & np.uint64(FEATURES - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(features)


class Model:
    """Labels, feature weights, lexicon, transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        size = len(labels)
        self.weights = np.zeros((FEATURES + 3 * size, size))
        self.moves = np.zeros((size, size))
        self.first = np.zeros(size)

    def features(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owners, found = grams(vocabulary)
        known = [(i, FEATURES + self.lexicon[word]) for i, word in enumerate(vocabulary) if word in self.lexicon]
        if known:
            more = np.array(known)
            owners, found = np.concatenate([owners, more[:, 0]]), np.concatenate([found, more[:, 1]])
        return owners, found

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        owners, found = self.features(vocabulary)
        columns = [np.bincount(owners, self.weights[found, k], len(vocabulary)) for k in range(len(self.labels))]
        return np.stack(columns, 1)


def lexicon(passages: list[tuple[str, list[str]]], labels: list[str]) -> dict[str, int]:
    """Word: 3 * language + strength, for words seen twice or more, the most frequent first."""
    counts = {label: Counter() for label in labels}
    for label, passage in passages:
        counts[label].update(passage)
    totals = {label: max(1, counter.total()) for label, counter in counts.items()}
    together = sum(counts.values(), Counter())
    entries = {}
    for word, n in sorted(together.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
        if n < 2:
            break
        rates = [counts[label][word] / totals[label] for label in labels]
        top = int(np.argmax(rates))
        part = rates[top] / sum(rates)
        entries[word] = 3 * top + (2 if part > 0.95 else 1 if part > 0.7 else 0)
    return entries


def chain(emit: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior of each label at each place of chains laid end to end, by blocked forward-backward.

    ``emit`` are log scores (places, labels); ``starts`` marks where a chain begins.
    """
    places, size = emit.shape
    n = -(-places // BLOCK)
    weight = np.ones((n * BLOCK, size))
    weight[:places] = np.exp(emit - emit.max(1, keepdims=True))
    start = np.ones(n * BLOCK, bool)
    start[:places] = starts
    weight, start = weight.reshape(n, BLOCK, size), start.reshape(n, BLOCK)
    step, begin = np.exp(moves - moves.max()), np.exp(first - first.max())

    products = np.broadcast_to(np.eye(size), (n, size, size)).copy()
    for j in range(BLOCK):
        moved = (products.reshape(-1, size) @ step).reshape(n, size, size)
        new = start[:, j]
        if new.any():
            moved[new] = products[new].sum(2, keepdims=True) * begin
        products = moved * weight[:, j, None, :]
        products /= products.max((1, 2), keepdims=True)

    into = np.empty((n, size))
    state = np.full(size, 1.0 / size)
    for b in range(n):
        into[b] = state
        state = state @ products[b]
        state /= state.sum()
    after = np.empty((n, size))
    state = np.ones(size)
    for b in range(n - 1, -1, -1):
        after[b] = state
        state = products[b] @ state
        state /= state.max()

    forward = np.empty((n, BLOCK, size))
    state = into
    for j in range(BLOCK):
        state = np.where(start[:, j, None], state.sum(1, keepdims=True) * begin, state @ step) * weight[:, j]
        state = state / state.sum(1, keepdims=True)
        forward[:, j] = state
    state = after
    for j in range(BLOCK - 1, -1, -1):
        forward[:, j] *= state
        scaled = state * weight[:, j]
        state = np.where(start[:, j, None], (scaled * begin).sum(1, keepdims=True), scaled @ step.T)
        state = state / state.max(1, keepdims=True)
    posterior = forward.reshape(-1, size)[:places]
    return posterior / posterior.sum(1, keepdims=True)


def pair_posteriors(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For training: posteriors and expected moves of equally long chains, ``emit`` (chains, places, labels)."""
    chains, places, size = emit.shape
    weight, step = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves)
    forward = np.empty_like(weight)
    state = np.exp(first) * weight[:, 0]
    for j in range(places):
        if j:
            state = (state @ step) * weight[:, j]
        state = state / state.sum(1, keepdims=True)
        forward[:, j] = state
    expected = np.zeros((size, size))
    posterior = np.empty_like(weight)
    back = np.ones((chains, size))
    for j in range(places - 1, -1, -1):
        both = forward[:, j] * back
        posterior[:, j] = both / both.sum(1, keepdims=True)
        if j:
            right = weight[:, j] * back
            joint = forward[:, j - 1, :, None] * step * right[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = right @ step.T
            back = back / back.max(1, keepdims=True)
    return posterior, expected


def fit(passages: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Learns from passages of one language each. Deterministic."""
    labels = sorted({label for label, _ in passages})
    model = Model(labels, lexicon(passages, labels))
    size, random = len(labels), np.random.default_rng(seed)
    by_label = [[passage for label, passage in passages if label == name and passage] for name in labels]
    vocabulary = sorted({word for _, passage in passages for word in passage})
    if not vocabulary or size < 2:
        return model
    number = {word: i for i, word in enumerate(vocabulary)}
    owners, found = model.features(vocabulary)
    order = np.argsort(owners, kind="stable")
    found, ends = found[order], np.searchsorted(owners[order], np.arange(len(vocabulary) + 1))

    sequences = SEQUENCES * -(-size // LABELS)
    tokens, truth = np.empty((sequences, SEQUENCE), np.int64), np.empty((sequences, SEQUENCE), np.int64)
    for s in range(sequences):
        at = 0
        while at < SEQUENCE:
            label = int(random.integers(size))
            if not by_label[label]:
                continue
            passage = by_label[label][int(random.integers(len(by_label[label])))]
            # One sequence in three is of one language, the others change every few words.
            part = passage if s % 3 == 0 else passage[: int(random.integers(3, PASSAGE))]
            part = part[: SEQUENCE - at]
            tokens[s, at : at + len(part)] = [number[word] for word in part]
            truth[s, at : at + len(part)] = label
            at += len(part)

    parts = [model.weights, model.moves, model.first]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    rounds = 0
    for epoch in range(EPOCHS):
        shuffled = random.permutation(sequences)
        for low in range(0, sequences, BATCH):
            chosen = shuffled[low : low + BATCH]
            flat = tokens[chosen].ravel()
            sizes = ends[flat + 1] - ends[flat]
            owner = np.repeat(np.arange(len(flat)), sizes)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            feature = found[np.repeat(ends[flat], sizes) + inside]
            emit = np.stack([np.bincount(owner, model.weights[feature, k], len(flat)) for k in range(size)], 1)
            posterior, expected = pair_posteriors(emit.reshape(len(chosen), SEQUENCE, size), model.moves, model.first)
            right = np.eye(size)[truth[chosen]]
            error = (right - posterior).reshape(-1, size)
            seen = np.bincount((truth[chosen][:, :-1] * size + truth[chosen][:, 1:]).ravel(), minlength=size * size)
            slopes = [
                np.stack([np.bincount(feature, error[owner, k], len(model.weights)) for k in range(size)], 1),
                seen.reshape(size, size) - expected,
                (right[:, 0] - posterior[:, 0]).sum(0),
            ]
            rounds += 1
            for part, slope, mean, square in zip(parts, slopes, means, squares):
                slope = slope / len(chosen) - 1e-3 * part
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope * slope - square)
                part += RATE * (mean / (1 - 0.9**rounds)) / (np.sqrt(square / (1 - 0.99**rounds)) + 1e-6)
    return model


def sample(labelled: DataFrame) -> list[tuple[str, list[str]]]:
    """Passages of a bounded number of documents per language, chosen by a hash of the text; copies count as one."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    # Only hashes of different texts are ranked; each task sends at most SAMPLE of them per language.
    chosen = rows.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= SAMPLE)
    chosen = chosen.select("lang", "h")
    found = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def step(batches):
        for batch in batches:
            labels, texts = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(text)
                stride = max(PASSAGE, len(words) // PASSAGES)
                for at in range(0, min(len(words), stride * PASSAGES), stride):
                    labels.append(label)
                    texts.append(" ".join(words[at : at + PASSAGE]))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(texts, pa.string())], ["lang", "passage"])

    collected = map_batches(found, step, "lang string, passage string").collect()
    return sorted((row["lang"], row["passage"].split()) for row in collected)


class Tagger:
    """A model with the emissions of the words seen so far, at most ``VOCABULARY`` of them."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.number) > VOCABULARY:
            self._forget()
        number = self.number
        new = list(dict.fromkeys(word for word in words if word not in number))
        if new:
            for word in new:
                number[word] = len(number)
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        return self.table[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def tag(self, texts: list[list[str]]) -> np.ndarray:
        """Posteriors of the words of texts, laid end to end."""
        words = [word for found in texts for word in found]
        ends = np.cumsum([len(found) for found in texts])
        starts = np.zeros(len(words) + 1, bool)
        starts[0] = True
        starts[ends] = True
        return chain(self.emissions(words), starts[:-1], self.model.moves, self.model.first)


def groups(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The words of texts, in groups of about ``GROUP`` words; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        found = split(text)
        if group and size + len(found) > GROUP:
            yield group
            group, size = [], 0
        group.append(found)
        size += len(found)
    if group:
        yield group


def spans(labels: list[str], posterior: np.ndarray) -> list[dict]:
    """Runs of words of one language."""
    top = posterior.argmax(1)
    cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
    return [{"start": a, "words": b - a, "lang": labels[top[a]]} for a, b in zip(cuts, cuts[1:])]


PREDICTED = "doc_id long, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language, score and the runs of languages (code switches) of every document."""
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))),
        ]
    )

    def step(batches):
        tagger = Tagger(model)
        for batch in batches:
            out, keys = [], iter(batch.column(0).to_pylist())
            for group in groups(batch.column(1).to_pylist()):
                posterior, at = tagger.tag(group) if model.labels and any(group) else None, 0
                for found in group:
                    row = {"doc_id": next(keys), "lang_pred": UNKNOWN, "score": 0.0, "spans": []}
                    if found and model.labels:
                        own = posterior[at : at + len(found)]
                        share = own.mean(0)
                        top = int(share.argmax())
                        row |= {"lang_pred": model.labels[top], "score": min(1.0, float(share[top])), "spans": spans(model.labels, own)}
                    out.append(row)
                    at += len(found)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), step, PREDICTED)


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """Learns from the rows for which ``learn_from`` holds, predicts for all."""
    return predict(docs, fit(sample(docs.filter(learn_from))))


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, with all columns, whose language is known with at least this share of the words."""
    place = docs.columns.index("text")

    def step(batches):
        tagger = Tagger(model)
        for batch in batches:
            keep = []
            for group in groups(batch.column(place).to_pylist()):
                posterior, at = tagger.tag(group) if model.labels and any(group) else None, 0
                for found in group:
                    keep.append(bool(found and model.labels and posterior[at : at + len(found)].mean(0).max() >= least))
                    at += len(found)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, step, docs.schema)
