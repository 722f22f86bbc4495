"""URL filter: rules first, then a ratio of two character models.

Two smoothed Markov models of variable order read a URL byte by byte: one is
counted on all accepted URLs, one on all rejected ones. A byte after the longest
context of ``ORDER`` bytes has the probability

    P_k = (n(context, byte) + t(context) * P_(k-1)) / (n(context) + t(context)),

where ``t`` counts the different bytes seen after the context, ``P_(k-1)`` drops
the context's first byte, and below the empty context all 256 bytes are alike;
a context that was never seen passes the shorter one on (Witten-Bell). A
URL's score is the mean difference of the two log probabilities over its bytes
and its end, in thousandths, from whole millionths per byte, so it does not
depend on the order of summation.

Calibration: every URL belongs to one of two folds by a hash. URLs with a known
label are scored by the counts of the other fold, and the threshold is the whole
number at which the shares of rightly accepted and rightly rejected URLs add up
to most (ties: nearest to 0, then the smaller). With labels of one kind only, that
verdict is given to all; without any label all URLs are accepted.

Counts of every order are tables that grow with the corpus: each place of a
labelled URL is one n-gram, counted where it is read; shorter ones are sums over
those, so a common n-gram is never gathered. The ``FREQUENT`` most frequent
n-grams, and no more, are broadcast; other places are looked up by a join. No
context has more than 256 following or preceding bytes.

A null URL is scored as an empty one, and no URL fails: those without ``://``
have an empty host and path, fit no rule and get the models' verdict. Repeated
rows count as often as they occur and get the same verdict. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furlong.llm.common import Scope, map_batches

ORDER = 5
FREQUENT = 1 << 17
# Scores beyond this many thousandths count as this when the threshold is sought.
FARTHEST = 20_000
END = 1


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, in ASCII lower case, and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(url: str | None, order: int = ORDER) -> np.ndarray:
    """One number per byte and for the end: the byte with the ``order`` bytes before it, zeros before the start."""
    text = np.frombuffer(b"\0" * order + (url or "").encode() + bytes([END]), np.uint8).astype(np.int64)
    places = len(text) - order
    packed = np.zeros(places, np.int64)
    for i in range(order + 1):
        packed = (packed << 8) | text[i : i + places]
    return packed


def count(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram`` and its counts in all accepted and rejected URLs and in those of the first fold.

    ``urls`` holds ``url``, ``accepted`` (null: no label) and ``fold`` (0 or 1).
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(grams(u, order), 2 * f + (not a)) for u, a, f in zip(*(c.to_pylist() for c in batch.columns)) if a is not None]
            if not known:
                continue
            packed = np.concatenate([g for g, _ in known])
            kind = np.repeat([k for _, k in known], [len(g) for g, _ in known])
            found, place = np.unique(packed, return_inverse=True)
            n = np.bincount(place * 4 + kind, minlength=4 * len(found)).reshape(-1, 4)
            columns = [found, n[:, 0] + n[:, 2], n[:, 1] + n[:, 3], n[:, 0], n[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", *COUNTS])

    partial = map_batches(urls.select("url", "accepted", "fold"), step, "gram long, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ("yes", "no", "yes_0", "no_0")
# A score by all counts, and by those of the other fold.
MODELS = ("whole", "fold_0", "fold_1")


def _n(model: str, side: str) -> Column:
    """Counts of a model: all, or those without the fold to be scored."""
    return {"whole": F.col(side), "fold_0": F.col(side) - F.col(f"{side}_0"), "fold_1": F.col(f"{side}_0")}[model]


def ratios(counted: DataFrame, wanted: DataFrame, scope: Scope, order: int = ORDER) -> DataFrame:
    """``gram`` and, per model, ``whole``, ``fold_0``, ``fold_1``: the log ratio of its last byte in millionths.

    All n-grams of ``wanted`` and ``counted`` get a row.
    """
    base = counted.unionByName(wanted.select("gram", *[F.lit(0).cast("long").alias(c) for c in COUNTS]))
    tables = [scope.staged(base.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]), "url-counts")]
    for k in range(order, 0, -1):  # n-grams of k bytes
        shorter = F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")
        tables.append(scope.staged(tables[-1].groupBy(shorter).agg(*[F.sum(c).alias(c) for c in COUNTS]), "url-counts"))
    sides = [(m, s) for m in MODELS for s in ("yes", "no")]
    result = None
    for k, table in enumerate(reversed(tables)):
        context = F.shiftright("gram", 8)
        sums = [F.sum(_n(m, s)).alias(f"n_{m}_{s}") for m, s in sides]
        kinds = [F.count_if(_n(m, s) > 0).alias(f"t_{m}_{s}") for m, s in sides]
        contexts = table.groupBy(context.alias("context")).agg(*sums, *kinds)
        rows = table.withColumn("context", context).join(contexts, "context")
        if result is None:
            rows = rows.withColumns({f"b_{m}_{s}": F.lit(1 / 256) for m, s in sides})
        else:
            below = result.select(F.col("gram").alias("shorter"), *[F.col(f"p_{m}_{s}").alias(f"b_{m}_{s}") for m, s in sides])
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(below, "shorter")
        chances = []
        for m, s in sides:
            n, t, b = F.col(f"n_{m}_{s}"), F.col(f"t_{m}_{s}"), F.col(f"b_{m}_{s}")
            chances.append(F.when(n > 0, (_n(m, s) + t * b) / (n + t)).otherwise(b).alias(f"p_{m}_{s}"))
        result = rows.select("gram", *COUNTS, *chances)
    scores = [F.floor((F.log(f"p_{m}_yes") - F.log(f"p_{m}_no")) * 1_000_000 + 0.5).cast("long").alias(m) for m in MODELS]
    return result.select("gram", (F.col("yes") + F.col("no")).alias("n"), *scores)


@dataclass(frozen=True)
class Lookup:
    """The broadcast n-grams, sorted, with their scores."""

    grams: np.ndarray
    scores: np.ndarray

    def find(self, wanted: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores in the given column, 0 where the n-gram is not here, and which are here."""
        if not len(self.grams):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        place = np.minimum(np.searchsorted(self.grams, wanted), len(self.grams) - 1)
        known = self.grams[place] == wanted
        return np.where(known, self.scores[place, column], 0), known


def _different(urls: DataFrame, order: int) -> DataFrame:
    """The n-grams of all URLs, once per batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.unique(np.concatenate([grams(u, order) for u in batch.column(0).to_pylist()]))
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["gram"])

    return map_batches(urls.select("url"), step, "gram long").distinct()


def score(urls: DataFrame, table: DataFrame, scope: Scope, order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """Adds ``score`` in thousandths: by all counts for URLs without a label, by the other fold's for the rest.

    ``urls`` must be a stored table with ``row``, a number of its own for every row.
    """
    common = table.orderBy(F.desc("n"), "gram").limit(frequent).toArrow()  # at most ``frequent`` rows of four numbers
    place = np.argsort(common["gram"].to_numpy())
    lookup = Lookup(common["gram"].to_numpy()[place], np.stack([common[m].to_numpy() for m in MODELS], 1)[place])
    shared = urls.sparkSession.sparkContext.broadcast(lookup)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, texts, accepted, folds = (c.to_pylist() for c in batch.columns)
            packed = [grams(u, order) for u in texts]
            sizes = np.array([len(g) for g in packed])
            model = np.array([0 if a is None else 1 + f for a, f in zip(accepted, folds)])
            flat, column = np.concatenate(packed), np.repeat(model, sizes)
            found, here = known.find(flat, column)
            ends = np.cumsum(sizes)
            sums = np.add.reduceat(found, ends - sizes)
            missing = np.add.reduceat((~here).astype(np.int64), ends - sizes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(missing)]).astype(np.int32))
            left = pa.ListArray.from_arrays(offsets, pa.array(flat[~here]))
            columns = [pa.array(rows, pa.int64()), pa.array(model, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sums), left]
            yield pa.RecordBatch.from_arrays(columns, ["row", "model", "size", "sum", "left"])

    parts = map_batches(urls.select("row", "url", "accepted", "fold"), step, "row long, model int, size long, sum long, left array<long>")
    parts = scope.staged(parts, "url-parts")
    asked = parts.select("row", "model", F.explode("left").alias("gram"))
    asked = asked.groupBy("row", "model", "gram").agg(F.count("*").alias("times"))
    value = F.element_at(F.array(*[F.col(m) for m in MODELS]), F.col("model") + 1)
    rest = asked.join(table.select("gram", *MODELS), "gram").groupBy("row").agg(F.sum(value * F.col("times")).alias("rest"))
    whole = F.col("sum") + F.coalesce("rest", F.lit(0))
    scored = parts.join(rest, "row", "left").select(F.col("row").alias("of"), F.floor(whole / (F.col("size") * 1000)).cast("long").alias("score"))
    return urls.join(scored, F.col("row") == F.col("of")).drop("of")


def threshold(scored: DataFrame) -> int | None:
    """The least score that is accepted; none where labels are of one kind or missing.

    Scores are cut at ``FARTHEST`` on either side, so one ordered table of at most 40,001 rows decides.
    """
    bin_ = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col("score"))).cast("long").alias("at")
    bins = scored.filter(F.col("accepted").isNotNull()).groupBy(bin_)
    bins = bins.agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    everything, below = W.partitionBy(), W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumns({"all_yes": F.sum("yes").over(everything), "all_no": F.sum("no").over(everything)})
    right = F.col("all_no").cast("double") * (F.col("all_yes") - F.coalesce(F.sum("yes").over(below), F.lit(0)))
    right = right + F.col("all_yes").cast("double") * F.coalesce(F.sum("no").over(below), F.lit(0))
    # From behind the score before up to this one, every number decides alike.
    least = F.coalesce(F.lag("at").over(W.orderBy("at")) + 1, F.lit(-FARTHEST))
    bins = bins.withColumns({"right": right, "least": least}).withColumn("at", F.greatest("least", F.least(F.col("at"), F.lit(0))))
    best = bins.filter("all_yes > 0 and all_no > 0").orderBy(F.desc("right"), F.abs("at"), "at").select("at").first()
    return None if best is None else best["at"]


def judge(pages: DataFrame, rules: Sequence[Rule], fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    The URLs that a rule decides are the labelled ones; the models decide the others.
    """
    rows = pages.select("page_id", "url")
    host, path = split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    fold_of = fold or (lambda url: F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(2)))
    rows = rows.select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"),
        (F.col("found.verdict") == "allow").alias("accepted"), fold_of(F.col("url")).cast("int").alias("fold"),
    )
    scope = Scope()
    rows = scope.staged(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    table = scope.staged(ratios(count(rows), _different(rows, ORDER), scope), "url-grams")
    scored = scope.settled(score(rows, table, scope), "url-scores")
    least = threshold(scored)
    if least is None:
        kinds = {r["accepted"] for r in scored.select("accepted").filter("accepted is not null").distinct().collect()}  # two at most
        judged = F.lit("block" if kinds == {False} else "allow")
    else:
        # Judged as calibrated: scores beyond the ends of the scale count as its ends.
        judged = F.when(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col("score"))) >= least, "allow").otherwise("block")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
