"""Scalar rules: text cleaning, rounding, rates, ids, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text that selects a surface -------------------------------
TURF_MARKS = ("芝", "闃")
DIRT_MARKS = ("ダート", "繝繝ｼ繝")
# --- fixed values: result labels ---------------------------------------------
FINISH_STATUS_LABELS = {
    "did_not_finish": "中止",
    "disqualified": "失格",
    "scratched": "取消",
}
NO_VALUE = "—"
BODY_WEIGHT_UNKNOWN = "未発表"
EVALUATION_NONE = "未評価"
EVALUATION_PARTIAL = "一部評価済み"
EVALUATION_COMPLETE = "評価済み"
# -----------------------------------------------------------------------------

# White space and line ends of ECMAScript; Spark's trim takes only the ASCII
# space unless it is given the characters.
_BLANKS = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

LAYOFF_DAYS = 56


def clean(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(clean(text), F.lit(""))


def surface_class(surface: Column) -> Column:
    """turf, dirt or other; turf wins when both words occur."""

    def has_any(marks: Sequence[str]) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | surface.contains(mark)
        return found

    return F.when(has_any(TURF_MARKS), "turf").when(has_any(DIRT_MARKS), "dirt").otherwise("other")


def round_ties_up(value: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits with ties towards +infinity.

    ``round`` sends -0.5 to -1; here -0.5 goes to 0. The fraction is tested
    instead of flooring ``value + 0.5``, which would itself round just below a tie.
    """
    factor = float(10**digits)
    scaled = value * F.lit(factor)
    below = F.floor(scaled)
    step = F.when(scaled - below >= 0.5, 1).otherwise(0)
    return (below + step) / F.lit(factor)


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; null when nothing was counted."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def internal_id(given: Column, provider: Column, entity: str, source: Column) -> Column:
    """The given id, or a version-5-shaped UUID taken from a SHA-256 digest."""
    digest = F.sha2(F.concat_ws(":", provider, F.lit(entity), source), 256)
    # The variant digit keeps its two low bits and gets the bits 10 in front.
    low_bits = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))
    variant = F.substring(F.lit("89ab"), low_bits + 1, F.lit(1))
    derived = F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
    return F.coalesce(blank_to_null(given), derived)


def tokyo_day(instant: Column, day: str) -> Column:
    """Whether the instant falls on that calendar day in Tokyo (half-open window)."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), "Asia/Tokyo")
    end = F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"), "Asia/Tokyo")
    return (instant >= start) & (instant < end)


def race_time_label(milliseconds: Column) -> Column:
    """93400 -> 1:33.4

    The tenth is the one nearest to the binary value of the seconds, a tie going
    up. Scaling the fraction by 2^52 makes it an integer, so the comparison with
    the tie is exact; a decimal formatter would round the shortest decimal text.
    """
    total = milliseconds.cast("double") / 1000
    seconds = total % 60
    whole = F.floor(seconds)
    fraction = ((seconds - whole) * float(2**52)).cast("long")
    tenths = F.shiftright(fraction * 10 + 2**51, 52)
    shown = F.lpad((whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), 2, "0")
    text = F.concat(
        F.floor(total / 60).cast("string"), F.lit(":"), shown, F.lit("."), (tenths % 10).cast("string")
    )
    return F.when(milliseconds.isNull(), NO_VALUE).otherwise(text)


def body_weight_label(weight: Column, change: Column) -> Column:
    """(480, 4) -> 480kg (+4)"""
    kilos = F.concat(weight.cast("string"), F.lit("kg"))
    signed = F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string"))
    return (
        F.when(weight.isNull(), BODY_WEIGHT_UNKNOWN)
        .when(change.isNull(), kilos)
        .otherwise(F.concat(kilos, F.lit(" ("), signed, F.lit(")")))
    )


def finish_label(position: Column, status: Column) -> Column:
    placed = F.coalesce(F.concat(position.cast("string"), F.lit("着")), F.lit(NO_VALUE))
    label = None
    for value, text in FINISH_STATUS_LABELS.items():
        label = F.when(status == value, text) if label is None else label.when(status == value, text)
    return label.otherwise(placed)


def evaluation_label(predicted: Column, evaluated: Column) -> Column:
    partly = F.concat(
        F.lit(EVALUATION_PARTIAL + " "), evaluated.cast("string"), F.lit("/"), predicted.cast("string")
    )
    return (
        F.when(evaluated == 0, EVALUATION_NONE)
        .when(evaluated < predicted, partly)
        .otherwise(EVALUATION_COMPLETE)
    )
