"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q and a length of at least
``LEAST`` words and two periods that no neighbouring word extends. At scale B (a
power of two) the text is cut into blocks of B words, and periods from 2B - 1 to
4B - 2 are searched: what a run of such a period repeats is at least 2B - 1
words long, so it holds a whole block, and that block occurs again q words
later. The sum of squared differences of word numbers between the block and
every place of the window that follows it comes from three number-theoretic
transforms of 4B residues, all blocks of a scale in one batch. Places where the
sum is zero are compared word by word and extended both ways at that distance.

A block is transformed only if each of its words occurs again within the largest
distance of the scale, without which no distance gives zero; and not if it and
its whole window lie in a known run of period B or less, where every distance
with zero is a multiple of that period.

Null and empty texts have no words and no runs. Repeated rows give repeated
results. Whole texts are searched, whatever their length; a transform holds
the residues of some blocks, at most ``RESIDUES`` or one block's. Other columns
are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furlong.llm.common import map_batches

LEAST = 12
# 15 * 2**27 + 1 and a generator of its residues: transforms of up to 2**27 places.
PRIME = 2013265921
GENERATOR = 31
# Residues transformed at once.
RESIDUES = 1 << 17
KEPT_ROOTS = 1 << 15

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first ``size // 2`` powers of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(1, np.int64)
    while len(powers) < size // 2:
        powers = np.concatenate([powers, powers * pow(root, len(powers), PRIME) % PRIME])
    return powers


_kept_powers = functools.lru_cache(maxsize=64)(_powers)


def _roots(size: int, inverse: bool) -> np.ndarray:
    return (_kept_powers if size <= KEPT_ROOTS else _powers)(size, inverse)


def transform(rows: np.ndarray) -> np.ndarray:
    """Forward transform of every row; the result stands in bit-reversed order."""
    count, size = rows.shape
    rows, roots, half = rows.copy(), _roots(size, False), size // 2
    while half:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :].copy()
        pairs[:, :, 0, :] = (low + high) % PRIME
        pairs[:, :, 1, :] = (low - high) * roots[:: size // (2 * half)] % PRIME
        half //= 2
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``, from bit-reversed order."""
    count, size = rows.shape
    rows, roots, half = rows.copy(), _roots(size, True), 1
    while half < size:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :] * roots[:: size // (2 * half)] % PRIME
        pairs[:, :, 0, :] = (low + high) % PRIME
        pairs[:, :, 1, :] = (low - high) % PRIME
        half *= 2
    return rows * pow(size, PRIME - 2, PRIME) % PRIME


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row: the sum of squared differences, modulo the prime, of the block and every place of its window."""
    count, width = blocks.shape
    size = 1 << (width + windows.shape[1] - 2).bit_length()
    places = windows.shape[1] - width + 1
    turned, padded = np.zeros((count, size), np.int64), np.zeros((count, size), np.int64)
    turned[:, :width] = blocks[:, ::-1]
    padded[:, : windows.shape[1]] = windows
    products = restore(transform(turned) * transform(padded) % PRIME)[:, width - 1 : width - 1 + places]
    squares = np.zeros((count, windows.shape[1] + 1), np.int64)
    np.cumsum(windows * windows % PRIME, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % PRIME).sum(1, keepdims=True)
    return (own + squares[:, width:] - squares[:, :places] - 2 * products) % PRIME


def _gaps(words: np.ndarray) -> np.ndarray:
    """Distance of every word to its next occurrence; more than any text is long where there is none."""
    order = np.argsort(words, kind="stable")
    gaps = np.full(len(words), 1 << 40, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _stretch(words: np.ndarray, place: int, distance: int) -> tuple[int, int]:
    """The places around ``place``, end exclusive, whose words equal those ``distance`` later."""
    low = high = place
    end, step = len(words) - distance, 64
    while high < end:
        stop = min(end, high + step)
        differing = words[high:stop] != words[high + distance : stop + distance]
        if differing.any():
            high += int(differing.argmax())
            break
        high, step = stop, min(2 * step, 1 << 16)
    step = 64
    while low > 0:
        stop = max(0, low - step)
        differing = (words[stop:low] != words[stop + distance : low + distance])[::-1]
        if differing.any():
            low -= int(differing.argmax())
            break
        low, step = stop, min(2 * step, 1 << 16)
    return low, high


class _Reach:
    """Known runs of short periods: how far one that covers a place goes."""

    def __init__(self, found: dict[tuple[int, int], int], longest: int):
        short = sorted(span for span, period in found.items() if period <= longest)
        self.starts = np.array([start for start, _ in short], np.int64)
        self.ends = np.maximum.accumulate(np.array([end for _, end in short], np.int64)) if short else self.starts

    def beyond(self, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(places), bool)
        index = np.searchsorted(self.starts, places, "right") - 1
        return (index >= 0) & (self.ends[index] >= ends)


def _seeds(words: np.ndarray, gaps: np.ndarray, width: int, reach: _Reach) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of blocks and distances at which they occur again."""
    n, least, most = len(words), 2 * width - 1, 4 * width - 2
    whole = n // width
    starts = np.flatnonzero(gaps[: whole * width].reshape(whole, width).max(1) <= most) * width
    starts = starts[starts + least + width <= n]
    starts = starts[~reach.beyond(starts, starts + most + width)]
    if not len(starts):
        return
    # A number no word has stands behind the text.
    padded = np.concatenate([words, np.full(most + width, n, np.int64)])
    length = most - least + width
    batch = max(1, RESIDUES // (4 * width))
    for at in range(0, len(starts), batch):
        chosen = starts[at : at + batch]
        blocks = padded[chosen[:, None] + np.arange(width)]
        windows = padded[chosen[:, None] + least + np.arange(length)]
        row, place = np.nonzero(squared_differences(blocks, windows) == 0)
        yield chosen[row], place + least


def _by_distance(seeds: list[tuple[np.ndarray, np.ndarray]], width: int, reach: _Reach) -> Iterator[tuple[int, np.ndarray]]:
    """Every distance, in order, with the blocks that have it, but for those whose known run goes on that far."""
    if not seeds:
        return
    places, distances = (np.concatenate(part) for part in zip(*seeds))
    fresh = ~reach.beyond(places, places + distances + width)
    places, distances = places[fresh], distances[fresh]
    order = np.lexsort((places, distances))
    places, distances = places[order], distances[order]
    cuts = np.flatnonzero(np.diff(distances, prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(places)]):
        yield int(distances[low]), places[low:high]


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period."""
    n, found, width = len(words), {}, 1
    gaps = _gaps(words)
    while 2 * (2 * width - 1) <= n:
        reach = _Reach(found, width)
        for distance, group in _by_distance(list(_seeds(words, gaps, width, reach)), width, reach):
            at = 0
            while at < len(group):
                place = int(group[at])
                low, high = _stretch(words, place, distance)
                if high - low >= max(distance, least - distance):
                    found.setdefault((low, high + distance), distance)
                at = max(at + 1, int(np.searchsorted(group, high)))
        width *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change)[:-1].tolist()
    return b" ".join([word for word, n in zip(words, covered) if not n])


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, each below the count of words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(word, len(known)) for word in words], np.int64)


def search(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    words = text.encode().split() if text else []
    found = runs(numbers(words)) if len(words) >= LEAST else []
    return len(words), found, (collapse(words, found) if found else b" ".join(words)).decode()


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and period, in words, by start) and ``collapsed`` of every text."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, texts = zip(*(search(text.as_py()) for text in batch.column(1))) if batch.num_rows else ((), (), ())
            offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
            flat = np.array([run for found in spans for run in found], np.int64).reshape(-1, 3)
            parts = [pa.array(flat[:, i]) for i in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(RUN)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(rows, step, schema)
