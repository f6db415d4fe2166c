"""Multi-label metrics from one aggregate, tail metrics, and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.sources.scratch import stored

METRICS = ("hamming_accuracy", "subset_accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")


def _ratio(a: Column, b: Column) -> Column:
    """1 where the denominator is 0."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def report(predicted: DataFrame, truth: DataFrame, vocab: DataFrame, n_rows: int) -> DataFrame:
    """One row of the eight metrics of cells ``(rid, item)`` over the whole label vocabulary and all rows."""
    both = predicted.select("rid", "item").distinct().withColumn("p", F.lit(1)).join(truth.select("rid", "item").distinct().withColumn("t", F.lit(1)), ["rid", "item"], "full").fillna(0, ["p", "t"]).persist()
    by_label = both.groupBy("item").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    by_label = vocab.select("item").join(by_label, "item", "left").fillna(0, ["tp", "fp", "fn"])
    by_label = by_label.withColumn("pr", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("re", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    sums = by_label.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("l"), F.avg("pr").alias("macro_precision"), F.avg("re").alias("macro_recall"), F.avg(_f1(F.col("pr"), F.col("re"))).alias("macro_f1"))
    wrong = both.where("p <> t").agg(F.count_distinct("rid").alias("wrong"))
    out = sums.crossJoin(wrong).withColumn("micro_precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall"))).withColumn("hamming_accuracy", 1 - (F.col("fp") + F.col("fn")) / (F.lit(n_rows) * F.col("l"))).withColumn("subset_accuracy", 1 - F.col("wrong") / F.lit(n_rows))
    return out.select(*METRICS)


def melted(wide: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "score") -> DataFrame:
    return wide.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, name, value)


def tail_report(sets: DataFrame, assign: DataFrame, edges: DataFrame, n_rows: int) -> DataFrame:
    """Support, frequency, area, length, edge density and edge ratio of label sets; missing edges count 0, undefined values are null."""
    supp = assign.groupBy("sid").agg(F.count("*").alias("s"))
    parts = sets.select("sid", F.explode("items").alias("u"))
    sums = parts.join(parts.withColumnRenamed("u", "v"), "sid").where("u <> v").join(edges.select("u", "v", "proba"), ["u", "v"]).groupBy("sid").agg(F.sum("proba").alias("total"))
    n = F.size("items")
    out = sets.join(supp, "sid", "left").join(sums, "sid", "left").fillna(0, ["s", "total"])
    return out.select("sid", F.col("s").alias("support_size"), (F.col("s") / F.lit(n_rows)).alias("frequency"), (F.col("s") * n).alias("area"), n.cast("long").alias("length"),
                      F.try_divide(F.col("total"), n.cast("double")).alias("edge_density"), F.try_divide(F.col("total"), (n * (n - 1)).cast("double")).alias("edge_ratio"))


def _matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, nulls equal; without keys ``b`` is one row that is sent to every task."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(other[f"_{k}"])
    return a.join(other, same).drop(*(f"_{k}" for k in keys))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = 1024) -> DataFrame:
    """``keys, p<percent>...``: exact quantiles by group, interpolated between neighbours.

    Values are counted first; counts of value ranges tell in which range a rank lies, and only the values of those ranges are
    ranked, so no group's values are held in a buffer or sent to one task. Nulls do not count; a group of nulls only is absent, and without keys
    there is one row.
    """
    counted = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    ends = counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    ends = ends if keys else ends.where("_total IS NOT NULL")
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))
    ranged = _matched(counted, ends, keys).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0)).cast("int"))
    cells = ranged.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    # at most ``buckets`` rows a group
    upto = F.sum("_m").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b"))
    cells = cells.withColumn("_before", upto - F.col("_m"))
    at = [F.lit(q) * (F.col("_total") - 1) for q in shares]
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), fn(a).cast("long").alias("rank"), (a - F.floor(a)).alias("part"))
             for i, a in enumerate(at) for side, fn in ((0, F.floor), (1, F.ceil))]
    wanted = ends.select(*keys, F.explode(F.array(*ranks)).alias("_w")).select(*keys, "_w.*")
    hit = _matched(wanted, cells, keys).where("_before <= rank AND rank < _before + _m").select(*keys, "q", "side", "rank", "part", "_b", "_before")
    inside = _matched(ranged.select(*keys, "_b", "_v", "_n"), hit, [*keys, "_b"])
    running = F.sum("_n").over(Window.partitionBy(*keys, "q", "side").orderBy("_v"))
    found = inside.withColumn("_c", F.col("_before") + running).where("_c > rank").groupBy(*keys, "q", "side", "part").agg(F.min("_v").alias("v"))
    ends_of = lambda i, side: F.max(F.when((F.col("q") == i) & (F.col("side") == side), F.col("v")))
    part = lambda i: F.max(F.when(F.col("q") == i, F.col("part")))
    return found.groupBy(*keys).agg(*((ends_of(i, 0) * (1 - part(i)) + ends_of(i, 1) * part(i)).alias(f"p{int(q * 100)}") for i, q in enumerate(shares)))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum by group."""
    own = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    quarters = quantiles(df, keys, value, [0.25, 0.5, 0.75]).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & own[k].eqNullSafe(quarters[f"_{k}"])
    return own.join(quarters, same, "left").select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def ranked(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and deviation by group, best mean first."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).orderBy(F.desc("mean"), *keys)


def relative_difference(df: DataFrame, key: str, kind: str, value: str, one: str, other: str) -> DataFrame:
    """Best value of two kinds by key, and their difference relative to the second."""
    wide = df.groupBy(key).pivot(kind, [one, other]).agg(F.max(value))
    return wide.select(key, F.col(one).alias("one"), F.col(other).alias("other"), F.try_divide(F.col(one) - F.col(other), F.col(other)).alias("difference"))


def share_where(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_if(condition) / F.count("*")).alias("share"))


def mean_log(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, mean_log``: mean natural logarithm of the positive values of a group."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.avg(F.ln(value)).alias("mean_log"))
