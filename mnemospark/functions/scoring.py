"""Time, confidence and vector measures as columns. Time is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words


def epoch(text: Column) -> Column:
    """Seconds of an ISO time; 0 where it cannot be read."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(as_of) - F.unix_micros(ts)) / 8.64e10, F.lit(0.0)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(1.0))))


def effective(confidence: Column, ts: Column, as_of: Column) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) * F.pow(F.lit(0.5), age_days(ts, as_of) / words.HALF_LIFE)


def reinforced(confidence: Column, by: float = words.STEP) -> Column:
    """A stored 0 counts as 1, as a missing one does."""
    return clamp(F.when(confidence.isNull() | (confidence == 0), 1.0).otherwise(confidence) + by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    return F.transform(v, lambda x: x / norm)


def floats(blob: Column) -> Column:
    """The numbers of little-endian 32-bit floats that stand one after another in a binary column."""
    each = lambda i: F.concat(*[F.substr(F.hex(blob), i * 8 + F.lit(at), F.lit(2)) for at in (7, 5, 3, 1)])

    def number(i: Column) -> Column:
        bits = F.conv(each(i), 16, 10).cast("long")
        e, m = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
        size = F.when(e == 0, m * F.lit(2.0**-149)).when((e == 255) & (m == 0), F.lit(float("inf"))).when(e == 255, F.lit(float("nan"))).otherwise((m / F.lit(2.0**23) + 1) * F.pow(F.lit(2.0), e - 127))
        return F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size).cast("float")

    n = F.floor(F.octet_length(blob) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).when(blob.isNotNull(), F.expr("cast(array() as array<float>)"))
