"""Exact quantiles by selection: ranges narrowed around the wanted ranks, for all columns at once.

Every scan counts the rows of each column in buckets of the ranges that still hold a wanted rank, with the least and the
greatest value of each bucket; the bucket with the rank is the next range. A bucket with one value ends its
search, so a tie of any size costs nothing. Buckets are even steps of the value, each cut again by even steps of
its logarithm, so values of very different sizes take a few scans too; the number of scans doesn't depend on the
number of columns. Nothing is sorted or written; per scan at most ``BUCKETS`` rows for each open range come back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, LOG_STEPS = 256, 32
BUCKETS = STEPS * LOG_STEPS
_INF = float("inf")


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(_INF), x)  # neither infinite nor NaN


class _Ranks:
    """Values of one column at some ranks; infinite values and NaN (the greatest) are counted, not searched."""

    def __init__(self, ranks: list[int], total: int, low: int, high: int, nan: int, least: float, greatest: float):
        self.found: dict[int, float] = {}
        self.open: dict[tuple[float, float], list[tuple[int, int]]] = {}  # range -> (rank, rows below the range)
        for rank in ranks:
            if rank < low:
                self.found[rank] = -_INF
            elif rank >= total - nan:
                self.found[rank] = math.nan
            elif rank >= total - nan - high:
                self.found[rank] = _INF
            elif least == greatest:
                self.found[rank] = least
            else:
                self.open.setdefault((least, greatest), []).append((rank, low))

    def narrow(self, counts: dict[tuple[float, float], list[tuple[int, float, float]]]) -> None:
        """``counts``: per range the buckets in order, as (rows, least, greatest)."""
        ranges, self.open = self.open, {}
        for span, wanted in ranges.items():
            for rank, below in wanted:
                for n, least, greatest in counts[span]:
                    if rank < below + n:
                        if least == greatest:
                            self.found[rank] = least
                        else:
                            self.open.setdefault((least, greatest), []).append((rank, below))
                        break
                    below += n


def _interpolated(at: float, low: float, high: float) -> float:
    part = at - int(at)
    return low if part == 0 or low == high else low + (high - low) * part


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, with linear interpolation between neighbouring ranks; nulls are left
    out, and a column without values has null quantiles."""
    values = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    start = []
    for i in range(len(columns)):
        x = F.col(f"_{i}")
        start += [
            F.count(x), F.count_if(x == -_INF), F.count_if((x == _INF)), F.count_if(F.isnan(x)),
            F.min(_finite(x)), F.max(_finite(x)),
        ]
    first = values.agg(*[c.alias(f"s{k}") for k, c in enumerate(start)]).first()
    states: list[_Ranks | None] = []
    for i in range(len(columns)):
        total, low, high, nan, least, greatest = first[6 * i : 6 * i + 6]
        ranks = sorted({r for p in probs for r in (int(p * (total - 1)), min(int(p * (total - 1)) + 1, total - 1))}) if total else []
        states.append(_Ranks(ranks, total, low, high, nan, least, greatest) if total else None)
    while any(s and s.open for s in states):
        counts = _bucket_counts(values, [sorted(s.open) if s else [] for s in states])
        for i, s in enumerate(states):
            if s and s.open:
                s.narrow({span: counts[(i, k)] for k, span in enumerate(sorted(s.open))})
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        s, total = states[i], first[6 * i]
        ends = [(p * (total - 1), int(p * (total - 1))) for p in probs] if s else []
        out[c] = [_interpolated(at, s.found[r], s.found[min(r + 1, total - 1)]) for at, r in ends] if s else [None] * len(probs)
    return out


SMALLEST = 746.0  # above minus the logarithm of the smallest number


def _size(x: float) -> float:
    return math.copysign(math.log(abs(x)) + SMALLEST, x) if x else 0.0


def _step(x: Column, low: float, high: float, steps: int) -> Column:
    at = F.coalesce(F.try_divide(x - F.lit(low), F.lit(high - low)), F.lit(0.0)) * steps
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(steps - 1))


def _bucket_counts(values: DataFrame, spans: list[list[tuple[float, float]]]) -> dict[tuple[int, int], list[tuple[int, float, float]]]:
    """One scan: (rows, least, greatest) per bucket of every range; ranges of a column share at most their ends with none."""
    pairs = []
    for i, ranges in enumerate(spans):
        x = F.col(f"_{i}")
        if not ranges:
            continue
        number = F.lit(None).cast("bigint")
        for k, (low, high) in enumerate(ranges):
            # halves, so that the width of a range of opposite huge values stays finite
            even = _step(x / 2, low / 2, high / 2, STEPS)
            size = F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + SMALLEST))
            bucket = even * LOG_STEPS + _step(size, _size(low), _size(high), LOG_STEPS)
            bucket = F.when(x == F.lit(high), BUCKETS).otherwise(bucket)  # the greatest value is split off for sure
            number = F.when(x.between(low, high), F.lit(k * (BUCKETS + 1)) + bucket).otherwise(number)
        pairs.append(F.struct(F.lit(i).alias("c"), number.cast("bigint").alias("b"), x.alias("x")))
    rows = values.select(F.inline(F.array(*pairs))).filter(F.col("b").isNotNull())
    found = rows.groupBy("c", "b").agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect()
    out: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
    for c, b, n, least, greatest in sorted(map(tuple, found)):
        out.setdefault((c, b // (BUCKETS + 1)), []).append((n, least, greatest))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    return column_quantiles(df, [value], probs)[value]
