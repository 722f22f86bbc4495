"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct shingles of a few words (ASCII letters in
lower case), as 64-bit hashes; with fewer words the whole sequence is one
shingle. Each permutation gives a minimum and a maximum, so signatures of twice
as many values as permutations, cut into bands of ``ROWS``. Two sets at the
least similarity miss each other in all bands with a probability of 4e-7 at
three words and 0.85 (``LIKE``) and 3e-7 at five words and 0.80.

1. Documents with equal sets form a class, its smallest id stands for it.
2. In every bucket (band value) of two or more, all are compared with the
   smallest id, each pair once, on full sets. Links give components.
3. In buckets that still hold several components, members are dealt into blocks
   of ``BLOCK``, apart for the component of the smallest id and for the others;
   each block of the others meets every block in a tile, where pairs of
   different components are compared in the first band that they share. Only
   links leave a tile. So all candidates are either compared or already in one
   component, and no list of all pairs of a bucket is made.
4. The links of step 3 join the components.

Texts that are null or have no word have an empty set and no link. Rows of one
id are one document: what links to one of them links to the id. A row without an
id is a document of its own, known by a hash of its text (62 bits, below ``RESERVED``).
It takes part but names a component only where no row has an id; then all are
kept. Without an id and a set there is no component. Empty tables give no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Bounded, Scope, map_batches, maybe_in, words
from furlong.llm.components import components

ROWS = 5
BLOCK = 256
MEMO = 200_000
RESERVED = -(1 << 62)

MOST_HASHES = 128


@dataclass(frozen=True)
class Likeness:
    """Words of a shingle, least similarity, permutations (``MOST_HASHES`` at most), bands."""

    shingle: int
    percent: int
    hashes: int
    bands: int


LIKE = Likeness(3, 85, 64, 25)

_random = np.random.default_rng(20240)
_FACTORS = _random.integers(0, 1 << 63, MOST_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, MOST_HASHES, np.uint64) * np.uint64(2)
_MIX = _random.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_STIR = np.uint64(0x9E3779B97F4A7C15)


def word_memo() -> Bounded:
    return Bounded(lambda word: xxhash.xxh3_64_intdigest(word), MEMO)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STIR
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, memo: Bounded, size: int = LIKE.shingle) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = [word.lower() for word in words(text)]
    hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    if 0 < len(hashes) < size:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))], np.uint64)
    mixed = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        mixed = _stir(mixed + hashes[j : j + len(mixed)] * _MIX[j % len(_MIX)])
    return np.unique(mixed)


def signature(found: np.ndarray, hashes: int = LIKE.hashes) -> np.ndarray:
    """The minima, then the maxima, under all permutations."""
    low, high = np.full(hashes, ~np.uint64(0)), np.zeros(hashes, np.uint64)
    for at in range(0, len(found), 1024):
        values = (found[None, at : at + 1024] ^ _MASKS[:hashes, None]) * _FACTORS[:hashes, None]
        low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int = LIKE.bands) -> np.ndarray:
    """One key per band; keys of different bands differ."""
    rows = values[: bands * ROWS].reshape(bands, ROWS)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(ROWS):
        key = _stir(key + rows[:, j] * _MIX[j])
    return key.view(np.int64)


def similar(left: np.ndarray, right: np.ndarray, percent: int = LIKE.percent) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = sorted((len(left), len(right)))
    if 100 * small < percent * large or not small:
        return False
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def node_id() -> Column:
    """The id of a row's document; without one, the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), RESERVED - 1 - F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))


def signatures(docs: DataFrame, like: Likeness = LIKE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set, its ``bands`` (null for an empty set) and ``id``, see ``node_id``."""

    def step(batches):
        memo = word_memo()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, memo, like.shingle)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(signature(found, like.hashes), like.bands) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)],
                ["doc_id", "n_shingles", "digest", "bands", "id"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", node_id().alias("id"))
    return map_batches(rows, step, "doc_id long, n_shingles long, digest binary, bands array<long>, id long")


def confirmed(pairs: DataFrame, texts: DataFrame, like: Likeness = LIKE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def step(batches):
        memo = word_memo()
        for batch in batches:
            a, b, left, right = (column.to_pylist() for column in batch.columns)
            good, last, found = [], None, None
            for x, y in zip(left, right):
                if x != last:
                    last, found = x, shingles(x, memo, like.shingle)
                good.append(similar(found, shingles(y, memo, like.shingle), like.percent))
            rows = [i for i, linked in enumerate(good) if linked]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in rows], pa.int64()), pa.array([b[i] for i in rows], pa.int64())], ["a", "b"])

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    met = met.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return map_batches(met.select("a", "b", "left", "right"), step, "a long, b long")


def tile_links(tiles: DataFrame, like: Likeness = LIKE) -> DataFrame:
    """Links between different components among the rows of each tile."""

    def compare(table):
        memo = word_memo()
        rows = table.to_pylist()
        key, i, j = rows[0]["key"], rows[0]["i"], rows[0]["j"]
        sets = [shingles(row["text"], memo, like.shingle) for row in rows]
        bands = np.array([row["bands"] for row in rows], np.int64)
        band = int(np.flatnonzero(bands[0] == key)[0])
        root = {row["component"]: row["component"] for row in rows}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for x in range(len(rows)):
            earlier = (bands[x, :band] == bands[:, :band]).any(1)
            for y in range(x + 1, len(rows)):
                across = i == j or rows[x]["block"] != rows[y]["block"]
                if across and not earlier[y]:
                    left, right = find(rows[x]["component"]), find(rows[y]["component"])
                    if left != right and similar(sets[x], sets[y], like.percent):
                        root[max(left, right)] = min(left, right)
                        a.append(rows[x]["component"])
                        b.append(rows[y]["component"])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, like: Likeness = LIKE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row."""
    scope = Scope()
    signed = scope.staged(signatures(docs, like), "signatures")
    full = signed.filter(F.col("digest").isNotNull())
    node = F.coalesce(F.min("doc_id"), F.min("id"))
    classes = full.groupBy("digest").agg(node.alias("node"), F.min("doc_id").alias("name"), F.min_by("bands", "id").alias("bands"))
    classes = scope.staged(classes, "classes")

    # Buckets of two or more classes.
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("n"))
    members = scope.staged(members.join(buckets.filter("head < last").select("key", "head", "n"), "key"), "members")
    pairs = scope.staged(members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rows = docs.select(node_id().alias("node"), F.col("doc_id").isNotNull().alias("named"), "text").filter(F.col("text").isNotNull())
    likely = maybe_in(rows, asked, "node").filter("__maybe").drop("__maybe")
    # Rows without an id have the same node if they have the same text; one of them is enough.
    likely = likely.filter("named").unionByName(likely.filter("not named").dropDuplicates(["node"])).drop("named")
    texts = scope.staged(likely.join(asked.hint("merge"), "node"), "candidates")
    links = scope.staged(confirmed(pairs, texts, like), "confirmed")
    # Different sets under one id are one document.
    of_class = full.filter(F.col("doc_id").isNotNull()).select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    of_class = of_class.groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    ids = of_class.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a < b")
    found = components(links.unionByName(ids), scope)

    # Buckets that still hold several components. Members outside the head's component meet everyone.
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_head = F.max(F.when(F.col("node") == F.col("head"), F.col("component")))
    mixed = labelled.groupBy("key").agg(of_head.alias("major"), F.min("component").alias("low"), F.max("component").alias("high"))
    labelled = labelled.join(mixed.filter("low < high").select("key", "major"), "key")
    labelled = scope.staged(labelled.withColumn("minor", F.col("component") != F.col("major")).select("key", "node", "component", "minor"), "mixed")
    sizes = labelled.groupBy("key").agg(F.count_if("minor").alias("minors"), F.count_if(~F.col("minor")).alias("majors"))
    blocks = [F.ceil(F.col(name) / BLOCK).cast("int").alias(f"{name[:5]}_blocks") for name in ("minors", "majors")]
    labelled = labelled.join(sizes.select("key", *blocks), "key")
    place = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minor_blocks")).otherwise(F.col("major_blocks"))).cast("int")
    block = F.when(F.col("minor"), place).otherwise(F.col("minor_blocks") + place)
    partners = F.when(F.col("minor"), F.col("minor_blocks") + F.col("major_blocks")).otherwise(F.col("minor_blocks"))
    tiles = labelled.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
    tiles = tiles.select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = tiles.join(classes.select("node", "bands"), "node").join(texts, "node")
    more = scope.staged(tile_links(tiles, like), "tile-links")
    joined = components(more, scope).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = found.unionByName(more.select(F.col("a").alias("node"), F.col("a").alias("component")).unionByName(more.select(F.col("b").alias("node"), F.col("b").alias("component"))))
    final = final.distinct().join(joined, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    final = final.groupBy("node").agg(F.min("component").alias("component"))

    # The smallest id of a component names it, whatever its label is.
    labels = classes.select("digest", "node", "name").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labels.groupBy("component").agg(F.min("name").alias("name"), F.min("node").alias("least"))
    labels = scope.staged(labels.drop("name").join(names, "component").select("digest", "name", "least"), "names")
    named = full.join(labels, "digest").select("doc_id", "n_shingles", F.coalesce("name", "least").alias("component_id"), "name")
    # Rows with an empty set belong to what their id has otherwise.
    empty = signed.filter(F.col("digest").isNull())
    others = full.select("doc_id", "digest").join(empty.select("doc_id").distinct(), "doc_id").join(labels, "digest")
    others = others.groupBy("doc_id").agg(F.min("name").alias("name"))
    empty = empty.join(others, "doc_id", "left").withColumn("name", F.coalesce("name", "doc_id"))
    rows = named.unionByName(empty.select("doc_id", "n_shingles", F.col("name").alias("component_id"), "name"))
    rows = rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("name"), F.col("name").isNull())).drop("name")
    return scope.settled(rows, "near-duplicates")
