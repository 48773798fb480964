"""Safe arithmetic, training schedules and bucket numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_exp(x: Column) -> Column:
    """e^x; infinity where it overflows."""
    return F.exp(x)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def safe_mod(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_mod(a, b), F.lit(0))


def train_steps(epochs: Column, lines: Column, batch: Column) -> Column:
    return F.floor(epochs * F.ceil(lines / batch)).cast("bigint")


# Where the named schemes start to decay, in how many steps, and by what factor.
SCHEMES = {"luong10": (1, 2, 10, 0.5), "luong234": (2, 3, 4, 0.5)}


def decayed(rate: float, step: Column, total: int, scheme: str | None = None, start: int | None = None, every: int | None = None, factor: float | None = None) -> Column:
    """Learning rate (or sampling probability) at a step: constant until the start, then times `factor` after every so many steps (staircase)."""
    if scheme in SCHEMES:
        a, b, times, factor = SCHEMES[scheme]
        start = total * a // b
        every = (total - start) // times
    elif scheme not in (None, "", "manual"):
        raise ValueError(f"unknown decay scheme {scheme}")
    if not every or factor is None or start is None:
        return F.lit(float(rate))
    return F.when(step < start, F.lit(float(rate))).otherwise(F.lit(float(rate)) * F.pow(F.lit(float(factor)), F.floor((step - start) / every)))


def bucket_width(src_max_len: int | None, buckets: int) -> int:
    return (src_max_len + buckets - 1) // buckets if src_max_len else 10


def bucket(lengths: list[Column], src_max_len: int | None, buckets: int) -> Column:
    """Number of a sample's length bucket; `buckets` + 1 numbers can occur."""
    width = F.lit(bucket_width(src_max_len, buckets))
    parts = [F.floor(x / width).cast("int") for x in lengths]
    most = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return F.least(F.lit(buckets), most)


def pair_bucket(src: Column, tgt: Column, sizes: list[tuple[int, int]]) -> Column:
    """Index of the first (source, target) size that both lengths are below; null if none is."""
    out = None
    for k, (s, t) in enumerate(sizes):
        fits = (src < s) & (tgt < t)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return out


def decode_steps(longest: Column, factor: float) -> Column:
    return F.bround(longest * factor).cast("int")


def keep_probability(rate: Column, training: Column) -> Column:
    return F.when(training, 1 - rate).otherwise(F.lit(1.0))
