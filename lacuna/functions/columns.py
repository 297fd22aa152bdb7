"""Column expressions used by several operators. They stay in the JVM and never raise on empty or constant input."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bits of a draw, and of the range of draws that is sorted at a time.
DRAW_BITS, RANGE_BITS = 60, 10


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    product = F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def let(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, though a function of list elements may read it for each of them."""
    return F.transform(F.array(value), use)[0]


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalised(a: str) -> Column:
    """The vector divided by its length; zero vectors stay zero."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def euclidean(a: Column | str, b: Column | str) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def entropy_term(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    """Bits; 0 at 0 and 1."""
    return F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1, ties share the mean of their ranks."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(by.partitionBy(*keys, value)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null if either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def nearest_step(x: Column, step: int) -> Column:
    """The nearest multiple of ``step``, halves to even."""
    return (F.bround(x / step) * step).cast("int")


def draw(seed: int, *columns: str) -> Column:
    """60 bits drawn by a hash of the columns: the first 15 hexadecimal digits of an MD5, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def unit_draw(seed: int, *columns: str) -> Column:
    """A drawn number in [0, 1)."""
    return draw(seed, *columns) / float(1 << DRAW_BITS)


def numbered(rows: DataFrame, order: Column, tie: str, *keys: str, name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row of its keys in the order of a draw, then of ``tie``.

    No task sorts all rows: they are dealt into ranges of the draw, sorted inside them, and moved up by the sizes of the ranges before.
    """
    dealt = rows.withColumn("_draw", order).withColumn("_range", F.shiftright("_draw", DRAW_BITS - RANGE_BITS))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_range", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_draw", tie))
    return dealt.withColumn("_inside", inside).join(starts, [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_inside")).select(*rows.columns, name)


#: Rounds of ``permuted``, and the prime under which its numbers are mixed.
ROUNDS, PRIME = 16, 2147483647


@F.pandas_udf(LongType())
def moved_places(place: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    """Whole batches at a time; see ``permuted``."""
    mix = lambda v: v * (v % 65521 + 7) % PRIME
    at, size, key = (x.to_numpy(dtype=np.int64) for x in (place, n, key))
    for r in range(ROUNDS):
        turn = (key * 40503 + r * 7919) % PRIME
        other = (mix(turn) % size - at) % size
        swap = mix((np.maximum(at, other) * 2654435 + turn) % PRIME) // 4096 % 2 == 1
        at = np.where(swap, other, at)
    return pd.Series(at)


def permuted(place: str, n: str, seed: int, *keys: str) -> Column:
    """Where a permutation of 0 .. n-1 puts a place; each value of the integer keys has a permutation of its own.

    Arithmetic on the row alone, so nothing is sorted or moved. In each round a place and its mirror image about a point that the keys give
    change places or not, as one bit of a hash of the larger of the two says: a bijection, whatever the hash. ``plans.inputs.permuted_sql`` is the same in SQL.
    """
    key = F.lit(seed).cast("long")
    for c in keys:
        key = (key * 1000003 + F.col(c).cast("long")) % PRIME
    return moved_places(F.col(place).cast("long"), F.col(n).cast("long"), key)


#: How likely a Poisson number of mean 1 is at most 0, 1, 2, ...; beyond the last nothing is drawn.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9))


def poisson_counts(key: str, replicate: str) -> Column:
    """A hashed Poisson number of mean 1 for each row's key (of 60 bits, as from ``draw``) and replicate. ``plans.inputs.poisson_sql`` is the same in SQL."""
    mix = lambda v: (v * (v % 65521 + 7)) % PRIME
    start = (F.col(key) % PRIME + (F.col(replicate).cast("long") + 1) * 7368787) % PRIME
    u = F.transform(F.array(start), lambda v: mix(v) + F.shiftright(F.col(key), 31))
    u = F.transform(u, lambda v: (v % PRIME * 48271 + 11) % PRIME)
    return F.transform(F.transform(u, mix), lambda v: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda t: v >= t)))[0]
