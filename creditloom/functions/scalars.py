"""Null-safe column expressions. All run inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 1_000_000


def clip(c: Column, lo=None, hi=None) -> Column:
    """Limit to [lo, hi]; missing stays missing (``greatest`` and ``least`` would return the bound)."""
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    return out


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros and never cut longer text, unlike ``lpad``."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def number(c: Column) -> Column:
    """Text to double; text that is no number becomes NULL, and so does NaN."""
    value = F.trim(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else NULL."""
    return F.when(den > 0, num / den)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def discount_factor(quarter: Column, annual_rate: float = 0.05) -> Column:
    return F.lit(1.0) / F.pow(F.lit(1.0 + annual_rate), quarter / F.lit(4.0))


def percentage_points(phi: Column, base_rate: float = 0.008) -> Column:
    """Log-odds attribution to probability points around ``base_rate`` (slope of the logistic curve)."""
    return phi * F.lit(base_rate * (1.0 - base_rate) * 100.0)


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def hash_bucket(keys: Sequence[Column | str], seed: int = 42) -> Column:
    """Repeatable bucket in [0, 1e6) of a row key: the same under any partitioning, retry or file order."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(HASH_BUCKETS))


def code_label(c: Column, labels: Mapping[str, str], default: str | Column) -> Column:
    """Code to label through a literal map."""
    if not labels:
        return F.lit(default) if isinstance(default, str) else default
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.element_at(F.create_map(*pairs), c), fallback)


def case_below(c: Column, steps: Sequence[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """Label of the first upper limit that ``c`` is below; ``last`` when above all limits."""
    head = F.when(c.isNull(), F.lit(missing))
    return reduce(lambda acc, s: acc.when(c < s[0], F.lit(s[1])), steps, head).otherwise(F.lit(last))


def right_closed_bin(c: Column, edges: Column) -> Column:
    """Bin number 1..k for edges e0 < .. < ek: bins are (e, e'], the lowest edge belongs to bin 1.

    NULL outside the edges. ``width_bucket`` and the ML bucketizer close bins on the other side.
    """
    inside = (c >= F.element_at(edges, 1)) & (c <= F.element_at(edges, -1))
    below = F.size(F.filter(edges, lambda e: e < c))
    return F.when(inside, F.when(below < 1, F.lit(1)).otherwise(below))
