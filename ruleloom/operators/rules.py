"""Rules ``(rule_id, head, tail)``: supports, quality, distance and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.scalar import kl_bernoulli
from ruleloom.operators.sets import containment_division


def canonical(rules: DataFrame) -> DataFrame:
    """Sorted heads and tails, repeated rules dropped."""
    sort = rules.select("rule_id", *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("head", "tail")))
    return sort.groupBy("head", "tail").agg(F.min("rule_id").alias("rule_id")).select("rule_id", "head", "tail")


def validated(rules: DataFrame, x: DataFrame, vocab_x: DataFrame, vocab_y: DataFrame) -> DataFrame:
    """The rules whose head some row has; an item outside its vocabulary raises ``ValueError``."""
    for side, vocab in (("head", vocab_x), ("tail", vocab_y)):
        if not rules.select(F.explode(side).alias("item")).join(vocab, "item", "left_anti").isEmpty():
            raise ValueError(f"a {side} has an item outside the vocabulary")
    return rules.join(covers(x, rules, "head").select("rule_id").distinct(), "rule_id", "left_semi")


def covers(cells: DataFrame, rules: DataFrame, side: str) -> DataFrame:
    """``rid, rule_id`` of rows that have all items of a side."""
    return containment_division(cells, rules.select(F.col("rule_id").alias("sid"), F.col(side).alias("items"))).withColumnRenamed("sid", "rule_id")


def pair_statistics(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Statistics of all rules of one head item and one tail item that hold somewhere, from one join."""
    both = x.select("rid", F.col("item").alias("h")).join(y.select("rid", F.col("item").alias("t")), "rid").groupBy("h", "t").agg(F.count("*").alias("support"))
    hs = x.groupBy(F.col("item").alias("h")).agg(F.count("*").alias("head_support"))
    ts = y.groupBy(F.col("item").alias("t")).agg(F.count("*").alias("tail_support"))
    return _derived(both.join(hs, "h").join(ts, "t").withColumn("tail_len", F.lit(1)), n)


def _derived(counted: DataFrame, n: int) -> DataFrame:
    out = counted.withColumn("precision", F.col("support") / F.col("head_support")).withColumn("recall", F.try_divide("support", "tail_support")).withColumn("base_rate", F.col("tail_support") / F.lit(n))
    return out.withColumn("kl", kl_bernoulli(F.col("precision"), F.col("base_rate"))).withColumn("area", F.col("support") * F.col("tail_len")).drop("tail_len")


def statistics(rules: DataFrame, x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Support, precision, recall, base rate, divergence and label area of each rule whose head holds somewhere."""
    heads, tails = covers(x, rules, "head"), covers(y, rules, "tail")
    hs = heads.groupBy("rule_id").agg(F.count("*").alias("head_support"))
    ts = tails.groupBy("rule_id").agg(F.count("*").alias("tail_support"))
    both = heads.join(tails, ["rid", "rule_id"]).groupBy("rule_id").agg(F.count("*").alias("support"))
    counted = rules.withColumn("tail_len", F.size("tail")).join(hs, "rule_id").join(ts, "rule_id", "left").join(both, "rule_id", "left").fillna(0, ["support", "tail_support"])
    return _derived(counted, n)


def evaluation_batch(rules: DataFrame, x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """``statistics`` with each rule's F1 and its quality alone, divergence times label area."""
    out = statistics(rules, x, y, n)
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).withColumn("quality", F.col("kl") * F.col("area"))


def rectangles(rules: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """``rule_id, rid, item``: label cells of the rows where head and tail hold."""
    return covers(x, rules, "head").join(covers(y, rules, "tail"), ["rid", "rule_id"]).join(rules.select("rule_id", F.explode("tail").alias("item")), "rule_id").select("rule_id", "rid", "item")


def distances(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """``r1, r2, distance`` for pairs of a small rule set: one less the Jaccard similarity of their rectangles.

    Shared cells are the intersection, so pairs without any have distance 1; two rules of empty rectangles too.
    """
    sizes = rules.select("rule_id").join(cells.groupBy("rule_id").agg(F.count("*").alias("a")), "rule_id", "left").fillna(0, ["a"])
    one, two = (sizes.select(F.col("rule_id").alias(r), F.col("a").alias(f"a{k}")) for k, r in ((1, "r1"), (2, "r2")))
    shared = cells.withColumnRenamed("rule_id", "r1").join(cells.withColumnRenamed("rule_id", "r2"), ["rid", "item"]).where("r1 < r2").groupBy("r1", "r2").agg(F.count("*").alias("i"))
    pairs = one.join(two, F.col("r1") < F.col("r2")).join(shared, ["r1", "r2"], "left")
    return pairs.select("r1", "r2", (1 - F.coalesce(F.try_divide("i", F.col("a1") + F.col("a2") - F.col("i")), F.lit(0.0))).alias("distance"))


def marginal_coverage(cells: DataFrame, covered: DataFrame) -> DataFrame:
    """``rule_id, uncovered``: rectangle cells that ``covered(rid, item)`` lacks."""
    own = cells.select("rule_id").distinct()
    left = cells.join(covered.select("rid", "item").distinct(), ["rid", "item"], "left_anti").groupBy("rule_id").agg(F.count("*").alias("k"))
    return own.join(left, "rule_id", "left").select("rule_id", F.coalesce("k", F.lit(0)).alias("uncovered"))


def coverage_ratio(cells: DataFrame, y: DataFrame) -> DataFrame:
    """``ratio`` of label cells covered by any of the rules."""
    return cells.agg(F.count_distinct("rid", "item").alias("c")).crossJoin(y.agg(F.count("*").alias("n"))).select(F.try_divide("c", "n").alias("ratio"))


def summary(rules: DataFrame, vocab_x: DataFrame, vocab_y: DataFrame) -> DataFrame:
    """``rule_id, text`` with names for items."""
    def side(column: str, vocab: DataFrame) -> DataFrame:
        return rules.select("rule_id", F.explode(column).alias("item")).join(vocab, "item").groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(column))

    return side("head", vocab_x).join(side("tail", vocab_y), "rule_id").select("rule_id", F.format_string("%s -> %s", "head", "tail").alias("text"))
