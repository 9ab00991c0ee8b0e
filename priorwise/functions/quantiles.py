"""Exact quantiles of columns of any size: approximate brackets, counts around them, and the exact ranks among the few values inside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values inside all brackets that may come to the driver.
MOST = 200_000


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], most: int = MOST, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """For each column its quantiles with linear interpolation, as F.percentile gives them; nulls are left out, no values give None.

    One pass brackets each wanted rank by approximate quantiles, one counts the values below and inside each bracket, and the values inside
    are counted in Spark and come to the driver; brackets that hold too many are narrowed first. No task ever holds a column's values."""
    cols = list(wanted)
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    first = d.agg(*[x for i in range(len(cols)) for x in (F.count(f"c{i}"), F.min(f"c{i}"), F.max(f"c{i}"))]).first()
    ranks = {}  # (column, rank from 0) -> (low, high) of its bracket
    for i, c in enumerate(cols):
        if n := first[3 * i]:
            for p in wanted[c]:
                ranks |= {(i, int(p * (n - 1))): None, (i, min(n - 1, int(p * (n - 1)) + 1)): None}
    if not ranks:
        return {c: [None] * len(wanted[c]) for c in cols}
    at = {i: sorted(r for j, r in ranks if j == i) for i in {i for i, _ in ranks}}
    edge = 2 / accuracy
    near = lambda r, n, side: min(1.0, max(0.0, r / max(n - 1, 1) + side * edge))
    cuts = d.agg(*[F.percentile_approx(f"c{i}", [near(r, first[3 * i], s) for r in rs for s in (-1, 1)], accuracy).alias(f"q{i}") for i, rs in at.items()]).first()
    for i, rs in at.items():
        n, low, high = first[3 * i : 3 * i + 3]
        for k, r in enumerate(rs):
            a, b = cuts[f"q{i}"][2 * k : 2 * k + 2]
            ranks[i, r] = (low if near(r, n, -1) == 0 else a, high if near(r, n, 1) == 1 else b)
    for _ in range(40):
        spans = sorted({(i, *b) for (i, _), b in ranks.items()})
        counted = d.agg(*[x for i, a, b in spans for x in (F.count_if(F.col(f"c{i}") < a), F.count_if(F.col(f"c{i}").between(a, b)))]).first()
        below, inside = {s: counted[2 * k] for k, s in enumerate(spans)}, {s: counted[2 * k + 1] for k, s in enumerate(spans)}
        for (i, r), b in ranks.items():  # an approximate bracket that misses its rank is widened to the end of the column
            s = (i, *b)
            if r < below[s]:
                ranks[i, r] = (first[3 * i + 1], b[1])
            elif r >= below[s] + inside[s]:
                ranks[i, r] = (b[0], first[3 * i + 2])
        if any((i, *b) not in below for (i, _), b in ranks.items()):
            continue
        wide = [s for s in spans if inside[s] > most // len(spans) and s[1] < s[2]]
        if not wide:
            break
        mid = d.agg(*[F.percentile_approx(F.when(F.col(f"c{i}").between(a, b), F.col(f"c{i}")), [0.25, 0.5, 0.75], accuracy).alias(f"m{k}") for k, (i, a, b) in enumerate(wide)]).first()
        parts = [(i, a, b, sorted({a, *m, b})) for (i, a, b), m in zip(wide, mid)]
        tests = [(i, a, b, e, F.count_if(F.col(f"c{i}") <= e)) for i, a, b, es in parts for e in es]
        upto = d.agg(*[t[4] for t in tests]).first()
        under = {t[:4]: n for t, n in zip(tests, upto)}
        stuck = True
        for i, a, b, es in parts:
            for (j, r), bracket in list(ranks.items()):
                if j == i and bracket == (a, b):
                    high = next(e for e in es if under[i, a, b, e] > r)
                    low = max((e for e in es if under[i, a, b, e] <= r), default=a)
                    stuck = stuck and (low, high) == (a, b)
                    ranks[j, r] = (low, high)
        if stuck:
            break
    spans = sorted({(i, *b) for (i, _), b in ranks.items()})
    met = [_inside(i, [(a, b) for j, a, b in spans if j == i]) for i in at]
    rows = d.select(F.explode(F.array(*met)).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    below = dict(zip(spans, d.agg(*[F.count_if(F.col(f"c{i}") < a) for i, a, _ in spans]).first()))
    values = {}
    for (i, r), (a, b) in ranks.items():
        left = r - below[i, a, b]
        for v, n in sorted((x.v, x.n) for x in rows if x.i == i and a <= x.v <= b):
            if left < n:
                values[i, r] = v
                break
            left -= n
    out = {}
    for i, c in enumerate(cols):
        n = first[3 * i]
        out[c] = []
        for p in wanted[c]:
            if not n:
                out[c].append(None)
                continue
            pos = p * (n - 1)
            lo = int(pos)
            a, b = values[i, lo], values[i, min(n - 1, lo + 1)]
            out[c].append(a if a == b or pos == lo else (lo + 1 - pos) * a + (pos - lo) * b)
    return out


def _inside(i: int, brackets: Sequence[tuple[float, float]]):
    """(i, v): the column's value where a bracket has it, else null."""
    v = F.col(f"c{i}")
    test = F.lit(False)
    for a, b in brackets:
        test = test | v.between(a, b)
    return F.struct(F.lit(i).alias("i"), F.when(test, v).alias("v"))
