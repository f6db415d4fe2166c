"""Scalar and probability expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str) -> Column:
    """A reproducible uniform number in (0, 1) from a key: the first 32 bits of its MD5, centred."""
    text = F.concat_ws("|", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def kl_bernoulli(p: Column, q: Column) -> Column:
    """Divergence of Bernoulli(p) from Bernoulli(q) in nats, 0 where p is below q; 0 ln 0 is 0."""
    rest = F.when(p >= 1, F.lit(0.0)).otherwise((1 - p) * F.ln((1 - p) / (1 - q)))
    return F.when(p <= q, F.lit(0.0)).otherwise(p * F.ln(p / q) + rest)


def items_text(column: str = "items") -> Column:
    return F.array_join(F.transform(F.array_sort(column), lambda i: i.cast("string")), ",")


def product(column: str) -> Column:
    """Product of an array of doubles."""
    return F.aggregate(column, F.lit(1.0), lambda a, x: a * x)


def powerset(items: Column, empty: bool = False) -> Column:
    """All subsets of an array, smaller positions first; an array of more than 20 items raises an error."""
    items = F.when(F.size(items) > 20, F.raise_error(F.lit("a power set of more than 20 items"))).otherwise(items)
    sets = F.aggregate(items, F.array(F.array().cast("array<int>")), lambda a, x: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(x)))))
    return sets if empty else F.filter(sets, lambda s: F.size(s) > 0)


def bernoulli_subset(items: Column | str, *key: Column) -> Column:
    """Each item kept when its own uniform number is below one half."""
    return F.filter(items, lambda i: uniform(*key, i) < 0.5)


def filled_subset(items: Column, *key: Column) -> Column:
    """A subset of ``items`` that is not empty, all such subsets being equally likely; null for no items.

    The first item taken is number j with probability in proportion to 2^-j, the later ones are taken with one half each.
    """
    n = F.size(items)
    u = uniform(*key, F.lit("first"))
    first = F.least(F.floor(-F.log2(1 - u * (1 - F.pow(F.lit(2.0), -n)))) + 1, n).cast("int")
    later = F.filter(F.slice(items, first + 1, n), lambda i: uniform(*key, i) < 0.5)
    return F.when(n > 0, F.concat(F.slice(items, first, F.lit(1)), later))


def binomial(n: Column, k: Column) -> Column:
    """Number of k-subsets of n things, as a double; 0 outside 0 to n."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    value = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(k == 0, F.lit(1.0)).otherwise(F.round(value))


def rounding_threshold(p: float, q: float) -> float:
    """Fraction of ones above which a column belongs to a cluster, for densities ``p`` inside and ``q`` outside."""
    return math.log((1 - q) / (1 - p)) / math.log(p * (1 - q) / (q * (1 - p)))
