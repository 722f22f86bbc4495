"""Removal of passages that an earlier document holds, found with FM-indexes.

A window is ``WINDOW`` consecutive words of a document. Windows are grouped by
their anchor, the smallest hash of ``GRAM`` words in them; equal windows have
equal anchors. Neighbouring windows of one anchor form a stretch, about 25
windows long, so stretches are few and a repeated passage gives the same
stretches everywhere but at its ends.

1. Of documents with the same text, the smallest id is looked at; the others
   are covered wholly if they have a window at all.
2. Stretches of anchors that occur once are dropped. Equal stretches are
   counted together: those of larger ids than the smallest are covered.
3. Where an anchor has several different stretches, those of their smallest ids
   go to shards by anchor. A shard is indexed (see fm_index) and the stretches
   are streamed through it: where the matching statistics, within texts of
   smaller ids, reach ``WINDOW``, the window is covered.
4. Anchors with more than ``MOST`` different stretches, as at the ends of a
   passage that very many documents share, would make a shard of any size.
   Their windows are compared one by one through counts of window hashes, which
   is exact as well and splits any such group.

Windows are judged on the input; a window that occurs twice in one document
only, or only in rows of the same id, is not covered. Words are compared by
64-bit hashes. Null texts have no words. A null id is neither smaller nor larger
than any: nothing of it is removed and it removes nothing. Repeated rows of one
id and text are treated alike. Empty tables give no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Bounded, Scope, map_batches, maybe_in, words
from furlong.llm.fm_index import FmIndex

WINDOW = 50
GRAM = 8
MOST = 128
SHARD_WORDS = 150_000
MEMO = 400_000
GROUP = 50_000
PIECE = 50
BASE = np.uint64(0xD1342543DE82EF95)
UNBASE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

_random = np.random.default_rng(5050)
_MIX = _random.integers(0, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_STIR = np.uint64(0x9E3779B97F4A7C15)


def word_memo() -> Bounded:
    return Bounded(lambda word: xxhash.xxh3_64_intdigest(word), MEMO)


def word_hashes(text: str | None, memo: Bounded) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STIR
    return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    count = len(hashes) - size + 1
    mixed = np.zeros(count, np.uint64)
    for j in range(size):
        mixed = mixed + hashes[j : j + count] * _MIX[j]
    return _stir(mixed)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def prefix_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash and inverse powers, from which any part's hash follows."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), BASE)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), UNBASE)]))
    return np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * powers[:-1])]), inverse


def stretches(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Text number, anchor, digest, first window and number of windows of every stretch."""
    sizes = np.array([len(text) for text in texts], np.int64)
    hashes = np.concatenate(texts)
    if len(hashes) < WINDOW:
        return (np.empty(0, np.int64),) * 5
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    anchors = sliding_minimum(gram_hashes(hashes, GRAM), WINDOW - GRAM + 1)
    places = np.arange(len(anchors))
    inside = places + WINDOW <= ends[text[: len(anchors)]]
    begins = inside.copy()
    begins[1:] &= (anchors[1:] != anchors[:-1]) | (text[1 : len(anchors)] != text[: len(anchors) - 1])
    starts = np.flatnonzero(begins)
    # A stretch ends before the next one or where its text has no more windows.
    owners = text[starts]
    stops = np.minimum(np.concatenate([starts[1:], [len(hashes)]]), ends[owners] - WINDOW + 1)
    running, inverse = prefix_hashes(hashes)
    digests = _stir((running[stops + WINDOW - 1] - running[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return owners, anchors[starts].view(np.int64), digests.view(np.int64), starts - (ends - sizes)[owners], stops - starts


STRETCH = "doc_id long, tkey long, anchor long, digest long, start int, n int"


def all_stretches(texts: DataFrame) -> DataFrame:
    names = [part.split()[0] for part in STRETCH.split(", ")]

    def step(batches):
        memo = word_memo()
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = 0
            for group in in_groups(batch.column(2).to_pylist(), memo):
                owners, anchors, digests, starts, sizes = stretches(group)
                columns = [docs[done + owners], keys[done + owners], anchors, digests, starts.astype(np.int32), sizes.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)
                done += len(group)

    return map_batches(texts.select("doc_id", "tkey", "text"), step, STRETCH)


def in_groups(texts: list[str | None], memo: Bounded) -> Iterator[list[np.ndarray]]:
    """Word hashes of texts in groups of about ``GROUP`` words; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        hashes = word_hashes(text, memo)
        if group and size + len(hashes) > GROUP:
            yield group
            group, size = [], 0
        group.append(hashes)
        size += len(hashes)
    if group:
        yield group


CONTENT = "anchor long, doc_id long, tkey long, start int, hot boolean, words binary, starts array<int>"


def contents(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The words of the stretches asked for. For hot anchors, the windows: one row per text and hash, with all their places."""
    names = [part.split()[0] for part in CONTENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int32())]
    wanted = asked.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("asked"))

    def step(batches):
        memo = word_memo()
        for batch in batches:
            out = []
            for doc, key, rows, text in zip(*(column.to_pylist() for column in batch.columns)):
                hashes = word_hashes(text, memo)
                grams = gram_hashes(hashes, WINDOW).view(np.int64) if any(row["hot"] for row in rows) else None
                windows: dict[int, list[int]] = {}
                for row in rows:
                    start, n = row["start"], row["n"]
                    if row["hot"]:
                        for at in range(start, start + n):
                            windows.setdefault(int(grams[at]), []).append(at)
                    else:
                        out.append((row["anchor"], doc, key, start, False, hashes[start : start + n + WINDOW - 1].tobytes(), None))
                out += [(window, doc, key, None, True, None, starts) for window, starts in windows.items()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names)

    likely = maybe_in(texts, wanted, "doc_id").filter("__maybe").drop("__maybe")
    met = likely.join(wanted.hint("merge"), ["doc_id", "tkey"]).select("doc_id", "tkey", "asked", "text")
    return map_batches(met, step, CONTENT)


SPAN = "doc_id long, tkey long, start int, n int"


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def shard_spans(shards: DataFrame) -> DataFrame:
    """Covered windows of stretches, rows sorted by anchor; a shard is indexed and searched when it is full."""
    names = [part.split()[0] for part in SPAN.split(", ")]

    def search(rows: list) -> Iterator[pa.RecordBatch]:
        texts = [row[4] for row in rows]
        owners = np.array([row[1] for row in rows], np.int64)
        # Long stretches are streamed in pieces that overlap by one window less a word.
        pieces = [(i, at) for i, text in enumerate(texts) for at in range(0, len(text) - WINDOW + 1, PIECE)]
        streams = [texts[i][at : at + PIECE + WINDOW - 1] for i, at in pieces]
        whose = owners[[i for i, _ in pieces]]
        found = []
        for (i, at), longest in zip(pieces, FmIndex(texts, owners).matching_statistics(streams, whose, WINDOW)):
            _, doc, key, start, _ = rows[i]
            found += [(doc, key, start + at + first, n) for first, n in runs(longest >= WINDOW)]
        if found:
            columns = list(zip(*found))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def step(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, doc, key, start, held in zip(*(column.to_pylist() for column in batch.columns)):
                if size >= SHARD_WORDS and anchor != last:
                    yield from search(rows)
                    rows, size = [], 0
                rows.append((anchor, doc, key, start, np.frombuffer(held, np.uint64)))
                size += len(held) // 8
                last = anchor
        if rows:
            yield from search(rows)

    sorted_rows = shards.repartition("anchor").sortWithinPartitions("anchor")
    return map_batches(sorted_rows.select("anchor", "doc_id", "tkey", "start", "words"), step, SPAN)


def covered_windows(docs: DataFrame, scope: Scope) -> DataFrame:
    """``doc_id``, ``tkey`` (hash of the text), ``spans`` (start, n): windows whose words also start in a smaller id.

    Documents whose text a smaller id has are left to the caller.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text")
    first = rows.groupBy("tkey").agg(F.min("doc_id").alias("doc_id"))
    found = scope.staged(all_stretches(rows), "stretches").join(first, ["doc_id", "tkey"], "left_semi")

    anchors = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    anchors = anchors.filter("c > 1").select("anchor", (F.col("low") < F.col("high")).alias("several"))
    shared = scope.staged(found.join(anchors, "anchor"), "shared")
    groups = shared.groupBy("anchor", "digest", "several").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    variety = groups.filter("several").groupBy("anchor").agg((F.count("*") > MOST).alias("hot"))
    groups = groups.join(variety, "anchor", "left").filter("c > 1 or several").select("anchor", "digest", "first", "hot")
    known = scope.staged(shared.join(groups, ["anchor", "digest"]), "known")
    one_span = F.array(F.struct("start", "n")).alias("spans")
    whole = known.filter(F.col("doc_id") > F.col("first")).select("doc_id", "tkey", one_span)

    asked = known.filter(F.col("several") & (F.col("doc_id") == F.col("first"))).select("doc_id", "tkey", "anchor", "start", "n", "hot")
    pieces = scope.staged(contents(asked, rows), "contents")
    searched = shard_spans(pieces.filter(~F.col("hot"))).select("doc_id", "tkey", one_span)
    hot = pieces.filter("hot")
    earliest = hot.groupBy("anchor").agg(F.min("doc_id").alias("first"))
    single = hot.join(earliest, "anchor").filter(F.col("doc_id") > F.col("first"))
    single = single.select("doc_id", "tkey", F.transform("starts", lambda at: F.struct(at.alias("start"), F.lit(1).alias("n"))).alias("spans"))
    return whole.unionByName(searched).unionByName(single)


def marked(docs: DataFrame) -> DataFrame:
    """The rows with ``__copy`` (a smaller id has the same text) and ``__spans`` (covered windows)."""
    rows, scope = docs.withColumn("__key", F.xxhash64("text")), Scope()
    spans = covered_windows(docs, scope).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("__spans"))
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("tkey"))
    first = known.groupBy("tkey").agg(F.min("doc_id").alias("first"))
    copies = known.join(first, "tkey").filter(F.col("doc_id") > F.col("first")).select("doc_id", "tkey").distinct()
    marks = copies.withColumn("__copy", F.lit(True)).join(spans, ["doc_id", "tkey"], "full")
    marks = scope.settled(marks.withColumnsRenamed({"doc_id": "__doc", "tkey": "__tkey"}), "marks")
    # Rows that surely have no mark stay where they are; only the others meet the marks.
    split = maybe_in(rows, marks.select(F.col("__doc").alias("doc_id")), "doc_id")
    on = (F.col("doc_id") == F.col("__doc")) & (F.col("__key") == F.col("__tkey"))
    met = split.filter("__maybe").join(marks.hint("merge"), on, "left").select(*docs.columns, "__copy", "__spans")
    bare = {"__copy": F.lit(None).cast("boolean"), "__spans": F.lit(None).cast(marks.schema["__spans"].dataType)}
    return met.unionByName(split.filter("not __maybe").select(*docs.columns, *[value.alias(name) for name, value in bare.items()]))


def cut(text: str | None, copy: bool | None, spans: list[dict] | None) -> tuple[list[bytes], list[bytes]]:
    """The words of a text and those that stay."""
    own = words(text)
    if not copy and not spans:
        return own, own
    gone = np.full(len(own), bool(copy and len(own) >= WINDOW))
    for span in spans or ():
        gone[span["start"] : span["start"] + span["n"] + WINDOW - 1] = True
    return own, [own[i] for i in np.flatnonzero(~gone).tolist()]


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space) of every row."""
    names = [part.split()[0] for part in RESULT.split(", ")]

    def step(batches):
        for batch in batches:
            found = [cut(*row) for row in zip(*(column.to_pylist() for column in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(own) for own, _ in found], pa.int64()),
                    pa.array([len(own) - len(kept) for own, kept in found], pa.int64()),
                    pa.array([b" ".join(kept).decode() for _, kept in found], pa.string()),
                ],
                names,
            )

    rows = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(rows.select("doc_id", "text", "__copy", "__spans"), step, RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with what repeats taken out of ``text``, and ``n_chars`` to match; rows of which nothing is left go.

    A text of which nothing is removed stays as it is, white space included.
    """
    rows = marked(docs)
    at = {name: docs.columns.index(name) for name in ("text", "n_chars")}
    width = len(docs.columns)

    def step(batches):
        for batch in batches:
            texts, keep = [], []
            for text, copy, spans in zip(*(batch.column(i).to_pylist() for i in (at["text"], width, width + 1))):
                own, kept = cut(text, copy, spans)
                changed = len(kept) < len(own)
                texts.append(b" ".join(kept).decode() if changed else text)
                keep.append(bool(kept or not changed))
            columns = list(batch.columns[:width])
            columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
            columns[at["n_chars"]] = pa.array([None if text is None else len(text) for text in texts], columns[at["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(pa.array(keep, pa.bool_()))

    docs_names = docs.columns
    return map_batches(rows, step, docs.schema)
