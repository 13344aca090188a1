"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """Null, NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def safe_double(text: Column) -> Column:
    """A number read from text; blank, unreadable and non-finite ones are 0."""
    return F.coalesce(finite(F.trim(text.cast("string")).try_cast("double")), F.lit(0.0))


def signed_log(x: Column) -> Column:
    return F.coalesce(finite(F.signum(x) * F.log1p(F.abs(x))), F.lit(0.0))


def spread_or_one(x: Column) -> Column:
    """A standard deviation or quartile range; 1 where it is 0, null or non-finite."""
    return F.when(finite(x).isNotNull() & (x > 0), x).otherwise(F.lit(1.0))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two float arrays over their common length, in doubles."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def target_load(capacity: Column, reps: Column, bins: Column) -> Column:
    """Items that a bin would hold if all were equal."""
    room = F.greatest(capacity - reps, F.lit(0)).cast("double")
    return F.greatest(F.lit(1.0), room / F.greatest(bins, F.lit(1)))


def store_utility(d: Column, load: Column, mean: Column, target: Column, gamma: float, lo: float, hi: float) -> Column:
    """Novelty against the bin's mean distance, weighed by how empty the bin is; the distance itself without a bin."""
    near = F.greatest(d, F.lit(0.0))
    balance = clamp(F.pow((target + 1.0) / (load + 1.0), F.lit(gamma)), lo, hi)
    return F.when(finite(d).isNull(), F.lit(INF)).when(mean.isNull(), near).otherwise(near / F.greatest(mean, F.lit(1e-9)) * balance)


def rep_utility(d1: Column, d2: Column) -> Column:
    """A representative's utility from the distances of its two nearest others."""
    base = F.log1p(F.greatest(d1, F.lit(0.0)))
    bonus = F.when(finite(d2).isNotNull() & (d2 > 0), 1.0 + 0.25 * clamp(d1 / d2, 0.0, 1.0)).otherwise(F.lit(1.0))
    return F.when(finite(d1).isNull(), F.lit(INF)).otherwise(base * bonus)


def payload_bytes(*values: Column) -> Column:
    """24 bytes for key, version and utility, and the values' UTF-8 length."""
    sizes = [F.octet_length(F.coalesce(v.cast("string"), F.lit(""))) for v in values]
    return (F.lit(24) + reduce(lambda a, b: a + b, sizes)).cast("long")


def version_id(node: Column, counter: Column) -> Column:
    """The node in the upper 16 bits, the counter in the lower 48."""
    return F.shiftleft(node.cast("long"), 48).bitwiseOR(counter.cast("long").bitwiseAND(F.lit((1 << 48) - 1)))


def key_of(ident: Column, seq: Column) -> Column:
    """The id where it can be read as a long, else the row's number."""
    return F.coalesce(F.trim(ident.cast("string")).try_cast("bigint"), seq.cast("long"))


def dice(*parts: Column) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def owner(seq: Column, nodes: int) -> Column:
    return F.pmod(seq, F.lit(nodes)).cast("int")
