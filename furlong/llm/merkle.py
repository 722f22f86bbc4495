"""Merkle manifest of a dataset, with the proofs of all rows, by butterfly exchange.

Every row is a leaf; the leaves of a group (a language) form a tree of fanout
``FANOUT`` in the order of their ids, and the roots of the groups form the upper
tree. The leaves of a group are dealt over partitions of ``FANOUT ** HEIGHT``
consecutive ones, which are subtrees of equal height. Then rounds follow: in
round k the partitions whose numbers differ only in digit k (to the base of the
fanout) swap the roots they know. All of them hash the common ancestor, so each
has the siblings of its ancestor and the ancestor itself, and after the last
round the root and its whole upper proof, without a pass down. The grid of
partitions is filled up to a power of the fanout; an added partition starts
without a root, learns those of its neighbours in the rounds, and so stands in
for the missing partners of later rounds. The roots of the groups go through
the same exchange.

Leaves are numbered from one range sort: counts by (group, sorted part) give the
offsets, so a group that holds most rows is spread over many tasks. Texts are
hashed where they are read; only ids and digests are shuffled. An exchange
group holds at most ``FANOUT`` rows, a partition at most ``FANOUT ** HEIGHT`` leaves.

A null field is ``-``, an empty text ``0:``. A null group is a group, first in
order; null ids come first in their group. Rows of one id are ordered by leaf;
rows that are wholly equal take any order among themselves, which changes
nothing but which of them has which proof. A group of one row has its leaf as
root. Empty tables give no rows. Other columns are not looked at. The tables of
numbered leaves and of partitions stay in the shared folder, as the result is computed from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.llm.common import Scope, ship, staged

FANOUT = 8
# Leaves of a partition: FANOUT ** HEIGHT.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the values, each with its length in bytes, so that no two rows of values read alike."""
    fields = []
    for value in values:
        text = value.cast("string")
        fields.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return digest(F.concat(*fields))


def fold(found: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, found, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def joined(proof: Column) -> Column:
    """All digests of a proof in one text, from the leaf's siblings up."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _numbered(leaves: DataFrame, scope: Scope) -> DataFrame:
    """Adds ``grid`` (the group's number in order), ``place`` (in the group) and ``n`` (leaves of the group)."""
    # Staged first: a range sort reads its input twice, to find the edges and to deal the rows.
    leaves = scope.staged(leaves, "digests")
    order = [F.col(name).asc_nulls_first() for name in ("lang", "doc_id", "leaf", "spread")]
    # Wholly equal rows are told apart by where they were read, so that a sort can split them.
    spread = leaves.withColumn("spread", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    part = F.shiftright("seq", 33)
    rows = scope.settled(ranged.withColumn("seq", F.monotonically_increasing_id()), "leaves").withColumn("part", part)

    parts = rows.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # Groups are numbered in two steps as well: inside the part in which they begin, and part by part.
    groups = parts.groupBy("lang").agg(F.sum("n").alias("whole"), F.min("first").alias("begin")).withColumn("begins", F.shiftright("begin", 33))
    begun = groups.groupBy("begins").agg(F.count("*").alias("starts"))
    begun = begun.select("begins", (F.sum("starts").over(W.orderBy("begins")) - F.col("starts")).alias("started"))
    inside = F.row_number().over(W.partitionBy("begins").orderBy("begin")) - 1
    groups = groups.withColumn("inside", inside).join(begun, "begins")
    groups = groups.select(F.col("lang").alias("of"), "whole", (F.col("started") + F.col("inside")).alias("grid"))
    offsets = parts.join(groups, F.col("lang").eqNullSafe(F.col("of")))
    offsets = offsets.select("of", F.col("part").alias("in"), "first", "before", "grid", F.col("whole").alias("n"))
    same = F.col("lang").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))
    place = F.col("seq") - F.col("first") + F.col("before")
    return rows.join(offsets, same).select("doc_id", "lang", "leaf", "seen", "grid", place.alias("place"), "n")


def _height(n: Column, fanout: int) -> Column:
    """Levels above ``n`` nodes: 0 for a lone one."""
    powers = [fanout**k for k in range(62) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda power: power < n))


def exchange(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Butterfly exchange over the nodes 0..n-1 of every grid.

    ``nodes`` holds ``grid``, ``p`` and ``node``. Returned per node are ``grid``, ``p``,
    ``root`` and ``above``, the siblings left and right of its ancestor in every round.
    """
    sizes = nodes.groupBy("grid").agg(F.count("*").alias("cells"))
    sizes = sizes.withColumn("rounds", _height(F.col("cells"), fanout))
    most = sizes.agg(F.coalesce(F.max("rounds"), F.lit(0))).first()[0]
    steps = "array<struct<left: string, right: string>>"
    cells = nodes.join(sizes, "grid").withColumn("above", F.array().cast(steps))
    full = F.pow(F.lit(float(fanout)), F.col("rounds")).cast("long")
    # Cell p also adds the cells p + n, p + 2n, ... that fill up the grid.
    added = cells.filter(F.col("p") + F.col("cells") < full)
    added = added.withColumn("p", F.explode(F.sequence(F.col("p") + F.col("cells"), full - 1, F.col("cells"))))
    rows = cells.unionByName(added.withColumn("node", F.lit(None).cast("string")))
    for k in range(most):
        place = F.floor(F.col("p") / F.lit(fanout**k)) % fanout
        rows = rows.withColumn("digit", place).withColumn("meet", F.col("p") - place * F.lit(fanout**k))
        partners = F.sort_array(F.collect_list(F.struct("digit", "p", "node", "above")))
        rows = rows.groupBy("grid", "meet", "cells", "rounds").agg(partners.alias("partners"))
        known = F.filter("partners", lambda m: m["node"].isNotNull())

        def side(chosen):
            return F.array_join(F.transform(F.filter("known", chosen), lambda m: m["node"]), "")

        parent = F.when(F.size("known") > 0, digest(F.array_join(F.transform("known", lambda m: m["node"]), "")))

        def swapped(m):
            step = F.struct(side(lambda o: o["digit"] < m["digit"]).alias("left"), side(lambda o: o["digit"] > m["digit"]).alias("right"))
            ends = F.col("rounds") <= k
            return F.struct(
                m["p"].alias("p"),
                F.when(ends, m["node"]).otherwise(F.col("parent")).alias("node"),
                F.when(ends, m["above"]).otherwise(F.concat(m["above"], F.array(step))).alias("above"),
            )

        rows = rows.withColumn("known", known).withColumn("parent", parent)
        rows = rows.select("grid", "cells", "rounds", F.inline(F.transform("partners", swapped)))
    return rows.filter("p < cells").select("grid", "p", F.col("node").alias("root"), "above")


def levels(leaves: list[str], height: int, fanout: int = FANOUT) -> list[list[str]]:
    """Digests of a subtree, from the leaves up."""
    tree = [leaves]
    for _ in range(height):
        below = tree[-1]
        tree.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return tree


def proofs(tree: list[list[str]], fanout: int = FANOUT) -> tuple[list[list[str]], list[list[str]]]:
    """Per level: the siblings left and right of every leaf's ancestor, joined."""
    left, right = [], []
    for level, nodes in enumerate(tree[:-1]):
        before, after = [], []
        for i in range(len(nodes)):
            run = i - i % fanout
            before.append("".join(nodes[run:i]))
            after.append("".join(nodes[i + 1 : run + fanout]))
        ancestors = np.arange(len(tree[0])) // fanout**level
        left.append([before[i] for i in ancestors])
        right.append([after[i] for i in ancestors])
    return left, right


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``doc_id``, ``lang``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``seen`` of every row.

    ``proof`` lists, level by level from the leaf to the root, the joined digests left and right of the row's
    ancestor; see ``fold``. ``seen`` is the leaf of the row as it is found later, with the columns ``changed``.
    """
    ship(docs.sparkSession)
    now = {**{name: F.col(name) for name in fields}, **(changed or {})}
    found = leaf([now[name] for name in fields]) if changed else F.col("leaf")
    leaves = docs.select("doc_id", "lang", *[name for name in fields if name not in ("doc_id", "lang")])
    leaves = leaves.withColumn("leaf", leaf([F.col(name) for name in fields])).withColumn("seen", found)
    leaves = leaves.select("doc_id", "lang", F.unhex("leaf").alias("leaf"), F.unhex("seen").alias("seen"))

    size = FANOUT**HEIGHT
    rows = _numbered(leaves, Scope()).withColumn("p", F.floor(F.col("place") / size).cast("long"))
    rows = rows.withColumn("height", F.least(F.lit(HEIGHT), _height(F.col("n"), FANOUT)))
    # Digests are short but take time to hash, so partitions are not merged by their size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "grid", "p")

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree = levels([value.hex() for value in table["leaf"].to_pylist()], table["height"][0].as_py())
        first = table.slice(0, 1)
        return pa.table({"grid": first["grid"], "p": first["p"], "node": [tree[-1][0]]})

    tops = rows.groupBy("grid", "p").applyInArrow(top, "grid long, p long, node string")
    subroots = staged(exchange(tops), "partitions")
    groups = subroots.filter("p = 0").select(F.lit(0).cast("long").alias("grid"), F.col("grid").alias("p"), F.col("root").alias("node"))
    upper = exchange(groups).select(F.col("p").alias("grid"), F.col("root").alias("whole"), F.col("above").alias("further"))
    known = subroots.join(upper, "grid").select("grid", "p", "root", "whole", F.concat("above", "further").alias("above"))

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table.num_rows
        found = [value.hex() for value in table["leaf"].to_pylist()]
        left, right = proofs(levels(found, table["height"][0].as_py()))
        for step in above["above"][0].as_py():
            left.append([step["left"]] * n)
            right.append([step["right"]] * n)
        height = len(left)
        sides = [pa.array([values[i] for i in range(n) for values in side], pa.string()) for side in (left, right)]
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * height)
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(sides, fields=list(STEP)))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "lang": table["lang"],
                "leaf": found,
                "subroot": pa.array([above["root"][0].as_py()] * n, pa.string()),
                "root": pa.array([above["whole"][0].as_py()] * n, pa.string()),
                "proof": listed,
                "seen": [value.hex() for value in table["seen"].to_pylist()],
            }
        )

    types = {name: docs.schema[name].dataType.simpleString() for name in ("doc_id", "lang")}
    schema = (
        f"doc_id {types['doc_id']}, lang {types['lang']}, leaf string, subroot string, root string, "
        "proof array<struct<left: string, right: string>>, seen string"
    )
    return rows.groupBy("grid", "p").cogroup(known.groupBy("grid", "p")).applyInArrow(prove, schema)
