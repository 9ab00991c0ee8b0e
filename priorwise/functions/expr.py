"""Scalar expressions: rounding, logits, bins, normalised text, row-wise aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """c between low and high; null stays null."""
    c = col(c)
    out = c if low is None else F.when(c < low, F.lit(low)).otherwise(c)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Rounds halves to even."""
    return F.bround(col(c), digits)


def report(c: str | Column, digits: int = 6) -> Column:
    """Rounded for reports; negative zero becomes zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def sigmoid(z: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def nan_to_null(c: str | Column) -> Column:
    return F.when(F.isnan(col(c)), F.lit(None)).otherwise(col(c))


def finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def safe_cast(c: str | Column, kind: str) -> Column:
    """c as another type, null where it can't be one."""
    return col(c).try_cast(kind)


def hypotenuse(*columns: str | Column) -> Column:
    """The root of the sum of squares; null if any is."""
    return F.sqrt(reduce(add, [col(c).cast("double") * col(c).cast("double") for c in columns]))


def dictionary(c: str | Column, values: dict, default=None) -> Column:
    """A literal map with a default for values that it lacks."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(col(c) == k, F.lit(v)).otherwise(out)
    return out


def learned_codes(c: str | Column, levels: Sequence) -> Column:
    """1 to N in the sorted order of the levels, 0 for any other value (null too)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in sorted(levels)]), col(c)).cast("int"), F.lit(0))


def indicators(c: str, values: Sequence, prefix: str | None = None) -> list[Column]:
    return [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{prefix or c}_{v}") for v in values]


def null_count(columns: Sequence[str]) -> Column:
    return reduce(add, [F.col(c).isNull().cast("int") for c in columns], F.lit(0))


def bin_right(c: str | Column, edges: Sequence[float], lowest: bool = False) -> Column:
    """Right-closed bins (edges[i], edges[i + 1]], numbered from 0; outside or null: null. lowest: the first bin has its left edge too."""
    c = col(c)
    out = F.when(c <= edges[0], F.when(F.lit(lowest) & (c == edges[0]), F.lit(0)))
    for i, e in enumerate(edges[1:]):
        out = out.when(c <= e, F.lit(i))
    return out.cast("int")


def bin_left(c: str | Column, edges: Column) -> Column:
    """The number of edges (an array) that are at most c: left-closed bins; -1 for null or NaN."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e <= c)))


def bin_array(c: str | Column, edges: Column) -> Column:
    """Right-closed bins of an array of rising edges, the first with its left edge; null outside."""
    c = col(c)
    n = F.size(F.filter(edges, lambda e: e < c))
    return F.when((c < F.element_at(edges, 1)) | (c > F.element_at(edges, -1)) | c.isNull(), F.lit(None)).otherwise(F.greatest(n - 1, F.lit(0)))


def row_max(columns: Sequence[str | Column]) -> Column:
    return F.greatest(*map(col, columns))


def row_median(columns: Sequence[str | Column]) -> Column:
    """The mean of the middle two for an even number of columns."""
    s, k = F.array_sort(F.array(*map(col, columns))), len(columns)
    return (F.element_at(s, (k + 1) // 2) + F.element_at(s, k // 2 + 1)) / 2


def row_trimmed_mean(columns: Sequence[str | Column], cut: int = 1) -> Column:
    kept = F.slice(F.array_sort(F.array(*map(col, columns))), cut + 1, len(columns) - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / (len(columns) - 2 * cut)


def row_mean(columns: Sequence[str | Column]) -> Column:
    return reduce(add, map(col, columns)) / len(columns)


def row_spread(columns: Sequence[str | Column], centre: Column) -> Column:
    """The largest distance of a column from centre."""
    return F.greatest(*[F.abs(col(c) - centre) for c in columns])


def entropy(shares: Sequence[str | Column]) -> Column:
    return -reduce(add, [F.when(col(p) > 0, col(p) * F.log(col(p))).otherwise(0.0) for p in shares])


def normal_text(c: str | Column) -> Column:
    """Trimmed, lower case, each run of anything but letters and digits one underscore."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_")


def trailing_number(c: str | Column) -> Column:
    """The digits that end a text, as a number; null without any."""
    digits = F.regexp_extract(col(c), r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def initial(c: str | Column) -> Column:
    return F.upper(F.substring(col(c), 1, 1))


def products(numbers: Sequence[str], marks: Sequence[str] = ()) -> dict[str, Column]:
    """<a>_x_<b>: each pair of numbers, and each number with each 0/1 column; null if a factor is."""
    pairs = [(a, b) for i, a in enumerate(numbers) for b in [*numbers[i + 1 :], *marks]]
    return {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in pairs}


def trends(recent: Sequence[str], base: str) -> dict[str, Column]:
    """<rate>_dev: each recent rate less the long-run one, and <first>_trend: the first less the last; null if a part is."""
    out = {f"{r}_dev": F.col(r) - F.col(base) for r in recent}
    return out | ({f"{recent[0]}_trend": F.col(recent[0]) - F.col(recent[-1])} if len(recent) > 1 else {})


def oriented(first: Column, pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """own_<name> and other_<name> of paired columns (a, b): a is the own side where `first` holds, b where it doesn't; null if it is unknown."""
    out = {}
    for name, (a, b) in pairs.items():
        out[f"own_{name}"] = F.when(first, F.col(a)).when(~first, F.col(b))
        out[f"other_{name}"] = F.when(first, F.col(b)).when(~first, F.col(a))
    return out


def range_flags(c: str, ranges: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """1 where the column lies in a range, ends included, else 0; null counts as outside."""
    return {name: F.coalesce(F.col(c).between(a, b).cast("int"), F.lit(0)) for name, (a, b) in ranges.items()}
