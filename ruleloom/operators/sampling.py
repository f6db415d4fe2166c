"""Exact target distributions of pattern samplers, coverage state, and reproducible draws from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.scalar import bernoulli_subset, filled_subset, powerset, uniform
from ruleloom.operators.sets import items_of
from ruleloom.sources.scratch import stored


class NoMoreSamples(Exception):
    """Every weight is zero."""


def normalised(weights: DataFrame) -> DataFrame:
    """Adds ``proba``; uniform where all weights are zero."""
    total = weights.agg(F.sum("w").alias("_total"), F.count("*").alias("_n"))
    # one row
    return weights.crossJoin(F.broadcast(total)).withColumn("proba", F.when(F.col("_total") > 0, F.col("w") / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n"))).drop("_total", "_n")


def support_distribution(assign: DataFrame, space: DataFrame, area: bool = False) -> DataFrame:
    """``sid, w, proba`` in proportion to a set's support, or to support times size; sets without rows have weight 0."""
    own = assign.groupBy("sid").agg(F.count("*").alias("supp"))
    size = F.size("items") if area else F.lit(1)
    return normalised(space.join(own, "sid", "left").select("sid", (F.coalesce("supp", F.lit(0)) * size).cast("double").alias("w")))


def uncovered(assign: DataFrame, space: DataFrame, covered: DataFrame) -> DataFrame:
    """``rid, sid, item`` cells of contained sets that ``covered(rid, item)`` lacks."""
    cells = assign.join(space.select("sid", F.explode("items").alias("item")), "sid")
    return cells.join(covered.distinct(), ["rid", "item"], "left_anti")


def uncovered_area_distribution(assign: DataFrame, space: DataFrame, covered: DataFrame) -> DataFrame:
    """``sid, w, proba`` in proportion to the uncovered area of each set."""
    own = uncovered(assign, space, covered).groupBy("sid").agg(F.count("*").alias("area"))
    return normalised(space.join(own, "sid", "left").select("sid", F.coalesce("area", F.lit(0)).cast("double").alias("w")))


def row_weights(assign: DataFrame, space: DataFrame, covered: DataFrame, rows: DataFrame) -> DataFrame:
    """``rid, w, proba``: uncovered cells over the sets a row contains."""
    own = uncovered(assign, space, covered).groupBy("rid").agg(F.count("*").alias("area"))
    return normalised(rows.join(own, "rid", "left").select("rid", F.coalesce("area", F.lit(0)).cast("double").alias("w")))


def element_counters(assign: DataFrame, space: DataFrame, covered: DataFrame) -> DataFrame:
    """``rid, item, cnt``: contained sets of the row that have the item, for uncovered items."""
    return uncovered(assign, space, covered).groupBy("rid", "item").agg(F.count("*").alias("cnt"))


def head_distribution(assign: DataFrame, y: DataFrame, n_rows: int) -> DataFrame:
    """``tail, sid, w, proba`` for every single-label tail in one job: positives with the set times negatives without it.

    This closed form is the distribution that a coupled chain over (positive, negative) pairs draws from. Tails
    that all rows or none have get no distribution.
    """
    supp = assign.groupBy("sid").agg(F.count("*").alias("supp"))
    pos = y.groupBy(F.col("item").alias("tail")).agg(F.count("*").alias("n_pos")).where(F.col("n_pos") < n_rows)
    both = assign.join(y.select("rid", F.col("item").alias("tail")), "rid").groupBy("tail", "sid").agg(F.count("*").alias("plus"))
    weight = F.col("plus") * (F.lit(n_rows) - F.col("n_pos") - (F.col("supp") - F.col("plus")))
    w = both.join(supp, "sid").join(pos, "tail").select("tail", "sid", weight.cast("double").alias("w")).where("w > 0")
    return w.withColumn("proba", F.col("w") / F.sum("w").over(Window.partitionBy("tail")))


#: Pairs of rows that the distributions over pairs take.
MOST_PAIRS = 50_000_000


def pair_distribution(rows: DataFrame, target: DataFrame, full: bool = False) -> DataFrame:
    """``pos, neg, w, proba`` over positive and negative rows ``(rid, items)``: items only the positive has, or with
    ``full`` the patterns only it contains. All pairs are met: a check for small inputs, more than ``MOST_PAIRS`` raise ``ValueError``;
    samplers use the closed forms."""
    n, n_pos = rows.count(), rows.join(target.select("rid"), "rid", "left_semi").count()
    if n_pos * (n - n_pos) > MOST_PAIRS:
        raise ValueError("too many pairs of rows")
    flag = rows.join(target.select("rid").withColumn("y", F.lit(True)), "rid", "left")
    pos = flag.where("y").select(F.col("rid").alias("pos"), F.col("items").alias("p"))
    neg = flag.where("y IS NULL").select(F.col("rid").alias("neg"), F.col("items").alias("q"))
    size = F.size(F.array_except("p", "q"))
    w = (F.pow(F.lit(2.0), size) - 1) * F.pow(F.lit(2.0), F.size(F.array_intersect("p", "q"))) if full else size.cast("double")
    return normalised(pos.crossJoin(neg).select("pos", "neg", w.alias("w")).where("w > 0"))


def powerset_assign(rows: DataFrame) -> DataFrame:
    """``rid, items`` for every non-empty subset of a row; rows of at most 20 items."""
    return rows.select("rid", F.explode(powerset(F.col("items"))).alias("items"))


def powerset_distribution(rows: DataFrame, area: bool = False) -> DataFrame:
    """``items, w, proba`` over all non-empty patterns, by support or by support times size."""
    own = powerset_assign(rows).groupBy("items").agg(F.count("*").alias("supp"))
    return normalised(own.select("items", (F.col("supp") * (F.size("items") if area else F.lit(1))).cast("double").alias("w")))


def powerset_heads(rows: DataFrame, target: DataFrame) -> DataFrame:
    """``items, w, proba``: the discriminative distribution on the full power set."""
    flag = rows.join(target.select("rid").withColumn("y", F.lit(1)), "rid", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    n_neg = flag.where("y = 0").count()
    own = flag.select("y", F.explode(powerset(F.col("items"))).alias("items")).groupBy("items").agg(F.sum("y").alias("plus"), F.sum(1 - F.col("y")).alias("minus"))
    return normalised(own.select("items", (F.col("plus") * (n_neg - F.col("minus"))).cast("double").alias("w")).where("w > 0"))


def row_pattern_log_weights(rows: DataFrame, area: bool = False) -> DataFrame:
    """``rid, log_w``: ln of a row's number of patterns, or of their total size, safe for long rows."""
    n = F.size("items")
    return rows.select("rid", (F.ln(n.cast("double")) + (n - 1) * F.ln(F.lit(2.0)) if area else n * F.ln(F.lit(2.0))).alias("log_w"))


def proposal_weights(rows: DataFrame, target: DataFrame, n_space: int) -> DataFrame:
    """``rid, tight, original`` per row of contained sets ``(rid, items)``: size or 1, and square roots of set counts."""
    flag = rows.join(target.select("rid").withColumn("y", F.lit(True)), "rid", "left")
    n = F.size("items").cast("double")
    return flag.select("rid", F.when(F.col("y"), n).otherwise(F.lit(1.0)).alias("tight"), F.sqrt(F.when(F.col("y"), n).otherwise(n_space - n)).alias("original"))


def draw_inverse(weights: DataFrame, draws: int, seed: int, key: str) -> DataFrame:
    """``draw, <key>``: independent draws from one distribution by running sums and uniform numbers.

    The distribution is a sample space, ordered in one task; the draws are joined on ranges of a coarse bucket.
    """
    buckets = 1024
    spans = normalised(weights).where("proba > 0").withColumn("hi", F.sum("proba").over(Window.orderBy(key))).withColumn("lo", F.col("hi") - F.col("proba"))
    spans = spans.withColumn("b", F.explode(F.sequence(F.floor(F.greatest(F.col("lo"), F.lit(0.0)) * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets)))))
    points = weights.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(F.lit(seed), F.col("id")).alias("u")).withColumn("b", F.floor(F.col("u") * buckets))
    return points.join(spans, "b").where("u >= lo AND u < hi").select("draw", key)


def draw_per_group(weights: DataFrame, draws: int, seed: int, group: str, key: str) -> DataFrame:
    """``group, draw, key``: draws from many distributions at once by the largest Gumbel score."""
    numbered = weights.where("w > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    score = F.ln("w") - F.ln(-F.ln(uniform(F.lit(seed), F.col("draw"), F.col(group), F.col(key))))
    return numbered.groupBy(group, "draw").agg(F.max_by(key, F.struct(score, F.col(key))).alias(key))


def draw_rows(weights: DataFrame, draws: int, seed: int, key: str, buckets: int = 1024) -> DataFrame:
    """``draw, <key>``: independent draws from a table of any size: a hash bucket by its total, then a row by running sums in the bucket."""
    own = weights.where("w > 0").select(key, "w", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % buckets).alias("bucket"))
    totals = own.groupBy("bucket").agg(F.sum("w").alias("w"))
    picks = draw_inverse(totals, draws, seed, "bucket").join(totals.withColumnRenamed("w", "total"), "bucket").withColumn("at", F.col("total") * uniform(F.lit(seed), F.lit("row"), F.col("draw")))
    spans = own.withColumn("hi", F.sum("w").over(Window.partitionBy("bucket").orderBy(key))).withColumn("lo", F.col("hi") - F.col("w"))
    return picks.join(spans, "bucket").where("at >= lo AND at < hi").select("draw", key)


def pair_patterns(pairs: DataFrame, seed: int, *key: str) -> DataFrame:
    """Adds ``pattern`` to ``pairs(p, q, *key)``: half of the items only ``p`` has, never none of them, and half of the shared ones."""
    keys = [F.lit(seed), *map(F.col, key)]
    own = filled_subset(F.array_sort(F.array_except("p", "q")), *keys)
    return pairs.withColumn("pattern", F.array_sort(F.concat(own, bernoulli_subset(F.array_intersect("p", "q"), *keys, F.lit("both")))))


def pair_draws(x: DataFrame, target: DataFrame, rows: DataFrame, draws: int, seed: int, buckets: int = 1024) -> DataFrame:
    """``draw, item, pos, neg``: pairs of a positive and a negative row in proportion to the number of items only the positive has.

    A pair and one such item are drawn at once: the item in proportion to positives with it times negatives without it, then a
    row of either sort. Rows are drawn by counts of hash buckets and inside a bucket, so no pair of rows is formed but those drawn.
    """
    at = (F.conv(F.substring(F.md5(F.col("rid").cast("string")), 1, 8), 16, 10).cast("long") % buckets).alias("bucket")
    flag = rows.select("rid").join(target.select("rid").distinct().withColumn("y", F.lit(True)), "rid", "left").select("rid", F.coalesce("y", F.lit(False)).alias("y"), at)
    flag = stored(flag)
    held = x.join(flag, "rid")
    n_neg = flag.where("NOT y").count()
    by_item = held.groupBy("item").agg(F.count_if("y").alias("plus"), F.count_if(~F.col("y")).alias("minus"))
    items = draw_inverse(by_item.select("item", (F.col("plus") * (F.lit(n_neg) - F.col("minus"))).cast("double").alias("w")), draws, seed, "item")
    drawn = stored(items)

    def chosen(side: str, cells: DataFrame, counts: DataFrame) -> DataFrame:
        """A row of ``cells(item, bucket, rid)`` for each draw; ``counts(item, bucket, n)`` are the rows in each bucket."""
        upto = F.sum("n").over(Window.partitionBy("item").orderBy("bucket"))
        spans = counts.where("n > 0").withColumn("before", upto - F.col("n"))
        total = counts.groupBy("item").agg(F.sum("n").alias("total"))
        rank = drawn.join(total, "item").withColumn("rank", F.floor(uniform(F.lit(seed), F.lit(side), F.col("draw")) * F.col("total")))
        place = rank.join(spans, "item").where("rank >= before AND rank < before + n").select("draw", "item", "bucket", (F.col("rank") - F.col("before")).alias("k"))
        numbered = place.join(cells, ["item", "bucket"]) if side == "pos" else (
            place.join(flag.where("NOT y").select("bucket", "rid"), "bucket").join(cells.select("item", "rid"), ["item", "rid"], "left_anti"))
        order = F.row_number().over(Window.partitionBy("draw").orderBy("rid")) - 1
        return numbered.withColumn("at", order).where("at = k").select("draw", F.col("rid").alias(side))

    positive = held.where("y").select("item", "bucket", "rid")
    negative = held.where("NOT y").select("item", "bucket", "rid")
    having = negative.groupBy("item", "bucket").agg(F.count("*").alias("h"))
    sizes = flag.where("NOT y").groupBy("bucket").agg(F.count("*").alias("size"))
    # items that were drawn times a fixed number of buckets
    every = drawn.select("item").distinct().crossJoin(F.broadcast(sizes))
    lacking = every.join(having, ["item", "bucket"], "left").select("item", "bucket", (F.col("size") - F.coalesce("h", F.lit(0))).alias("n"))
    pos = chosen("pos", positive, positive.groupBy("item", "bucket").agg(F.count("*").alias("n")))
    return drawn.join(pos, "draw").join(chosen("neg", negative, lacking), "draw").select("draw", "item", "pos", "neg")


def greedy_tails(rows: DataFrame, together: DataFrame, draws: int, seed: int) -> DataFrame:
    """``draw, rid, items``: tails grown inside rows ``(rid, items)`` drawn in proportion to the total size of their patterns.

    Of a row with n items a size k is drawn in proportion to k - 1 (one item stays one), a first item uniformly, and each
    further one has the largest least co-occurrence ``together(a, b, n)`` with those chosen, ties to the smaller item. A step is
    one join over all draws.
    """
    n = F.size("items")
    weights = row_pattern_weights(rows.where("size(items) > 0"), area=True)
    drawn = draw_rows(weights, draws, seed, "rid").join(rows, "rid").withColumn("items", F.array_sort("items"))
    level_at = uniform(F.lit(seed), F.lit("size"), F.col("draw")) * (n * (n - 1) / 2)
    size = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: i * (i - 1) / 2 <= level_at)) + F.lit(1)
    first = F.element_at("items", (F.floor(uniform(F.lit(seed), F.lit("first"), F.col("draw")) * n) + 1).cast("int"))
    level = stored(drawn.select("draw", "rid", F.least(size, n).alias("k"), F.array(first).alias("chosen"), "items"))
    while not (growing := level.where("size(chosen) < k")).isEmpty():
        pairs = growing.select("draw", "chosen", F.explode(F.array_except("items", "chosen")).alias("a")).select("draw", "a", F.explode("chosen").alias("b"))
        least = pairs.join(together.select("a", "b", "n"), ["a", "b"], "left").groupBy("draw", "a").agg(F.min(F.coalesce("n", F.lit(0))).alias("m"))
        best = least.groupBy("draw").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a"))
        level = stored(level.join(best, "draw", "left").select("draw", "rid", "k", F.when(F.col("a").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("a"))).alias("chosen"), "items"))
    return level.select("draw", "rid", F.array_sort("chosen").alias("items"))


def row_pattern_weights(rows: DataFrame, area: bool = False) -> DataFrame:
    """``rid, w``: a row's number of patterns without the empty one, or their total size, relative to the largest row's, so that rows of any
    length have weights."""
    n = F.size("items")
    log = F.col("log_w") if area else F.col("log_w") + F.ln(1 - F.pow(F.lit(2.0), -n))
    own = row_pattern_log_weights(rows.where("size(items) > 0"), area).join(rows, "rid").select("rid", log.alias("log_w"))
    # one row
    return own.crossJoin(F.broadcast(own.agg(F.max("log_w").alias("_top")))).select("rid", F.exp(F.col("log_w") - F.col("_top")).alias("w"))


def draw_row_patterns(rows: DataFrame, draws: int, seed: int, area: bool = False) -> DataFrame:
    """``draw, items``: patterns in proportion to their support, or with ``area`` to support times size; none is empty.

    A row is drawn by the weight of its patterns. By support its non-empty subsets are equally likely; by area one item is there
    and each other with one half, which makes a subset as likely as it is large.
    """
    drawn = draw_rows(row_pattern_weights(rows, area), draws, seed, "rid").join(rows, "rid").withColumn("items", F.array_sort("items"))
    key = (F.lit(seed), F.col("draw"))
    if not area:
        return drawn.select("draw", filled_subset(F.col("items"), *key).alias("items"))
    sure = F.element_at("items", (F.floor(uniform(*key, F.lit("sure")) * F.size("items")) + 1).cast("int"))
    return drawn.withColumn("sure", sure).select("draw", F.filter("items", lambda i: (i == F.col("sure")) | (uniform(*key, i) < 0.5)).alias("items"))


def uniform_items(vocab: DataFrame, draws: int, seed: int) -> DataFrame:
    """``draw, item``: uniform draws of single items."""
    return draw_inverse(vocab.select("item", F.lit(1.0).alias("w")), draws, seed, "item")


def chain_trace(steps: DataFrame, chain: str = "chain") -> DataFrame:
    """``step, pos, neg, ratio, accepted`` of a replay of each ``chain`` over ``steps(step, pos, neg, w, bound, u)``.

    ``w`` is a candidate pair's weight and ``bound`` its proposal weight; the first candidate is taken and a later one when ``u``
    is below w bound' / (bound w'), primes being the current pair's. A chain's steps arrive in order and only the current pair is held, so a
    long chain takes time but no memory; chains run side by side.
    """
    import pyarrow as pa

    kind = steps.schema[chain].dataType.simpleString()
    ddl = f"{chain} {kind}, step int, pos int, neg int, ratio double, accepted boolean"
    ordered = steps.select(chain, "step", "pos", "neg", *(F.col(c).cast("double").alias(c) for c in ("w", "bound", "u")))

    def run(batches):
        last, held = run, (1.0, 1.0)  # no chain is named so
        for batch in batches:
            out: list[tuple] = []
            for own, step, pos, neg, w, bound, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != last:
                    last, held = own, (1.0, 1.0)
                ratio = w * held[1] / (bound * held[0])
                out.append((own, step, pos, neg, ratio, u < ratio))
                if u < ratio:
                    held = (w, bound)
            names = (chain, "step", "pos", "neg", "ratio", "accepted")
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=list(names))

    return ordered.repartition(chain).sortWithinPartitions(chain, "step").mapInArrow(run, ddl)


def greedy_head(x: DataFrame, target: DataFrame, universe: DataFrame | None = None, relative: bool = True, gamma: float = 0.5, epsilon: float = 0.1) -> list[int]:
    """Best prefix of a greedy item order: each step adds the item with the largest gain, covered positives - gamma covered negatives,
    divided by the item's frequency if ``relative``; ties go to the smaller item. The first item is always taken; the order ends when
    the rows covered fall below ``epsilon`` of the positives.

    Candidates are ``universe(item)``: by default every item of a positive row, or every item where positive rows have none. Each step is one
    aggregate, of which one row reaches the driver."""
    flag = target.select("rid").withColumn("y", F.lit(1))
    n_pos = flag.count()
    pruned = items_of(x, target) if universe is None else universe.select("item").distinct()
    cells = x if universe is None and pruned.isEmpty() else x.join(pruned, "item", "left_semi")
    cells = stored(cells.join(flag, "rid", "left").select("rid", "item", F.coalesce("y", F.lit(0)).alias("y")))
    freq = stored(cells.groupBy("item").agg(F.count("*").alias("freq")))
    chosen, best = [], (float("-inf"), 0)
    while True:
        counts = cells.groupBy("item").agg(F.sum("y").alias("p"), F.count("*").alias("n")).join(freq, "item")
        gain = F.col("p") - F.lit(gamma) * (F.col("n") - F.col("p"))
        gain = F.round(gain / F.col("freq") if relative else gain, 9)
        found = counts.select("item", "n", gain.alias("gain")).orderBy(F.desc("gain"), "item").limit(1).collect()
        if not found or chosen and found[0]["n"] < epsilon * n_pos:
            break
        item = found[0]["item"]
        chosen.append(item)
        own = cells.where(F.col("item") == item).select("rid")
        cells = cells.where(F.col("item") != item).join(own, "rid", "left_semi")
        if len(chosen) % 2 == 0:
            cells = stored(cells)
        if found[0]["gain"] > best[0]:
            best = (found[0]["gain"], len(chosen))
    return chosen[: best[1]]


def weights_after_naive(weights: DataFrame, assign: DataFrame, space: DataFrame, rows: DataFrame, items: list[int]) -> DataFrame:
    """``rid, w``: row weights less one for every contained set and item of ``items`` in it, in the rows of ``rows(rid)``.

    Not idempotent: what was covered before is taken off again. ``counters_after`` is the update to use."""
    hit = assign.join(rows.select("rid"), "rid", "left_semi").join(space.select("sid", F.explode("items").alias("item")).where(F.col("item").isin(items)), "sid")
    off = hit.groupBy("rid").agg(F.count("*").alias("off"))
    return weights.join(off, "rid", "left").select("rid", (F.col("w") - F.coalesce("off", F.lit(0))).alias("w"))


def counters_after(counters: DataFrame, rows: DataFrame, items: list[int]) -> DataFrame:
    """``rid, item, cnt`` less the counters of ``items`` in the rows of ``rows(rid)``; covering a cell twice changes nothing.

    Only counters that are still there are touched, so an update needs neither the sets nor what was covered before."""
    gone = counters.where(F.col("item").isin(items)).join(rows.select("rid"), "rid", "left_semi").select("rid", "item")
    return counters.join(gone, ["rid", "item"], "left_anti")


def counter_weights(counters: DataFrame, rows: DataFrame) -> DataFrame:
    """``rid, w, proba`` of all rows from their counters."""
    own = counters.groupBy("rid").agg(F.sum("cnt").alias("area"))
    return normalised(rows.join(own, "rid", "left").select("rid", F.coalesce("area", F.lit(0)).cast("double").alias("w")))


def sets_in_rows(drawn: DataFrame, assign: DataFrame, space: DataFrame, covered: DataFrame, seed: int) -> DataFrame:
    """``draw, rid, sid``: a set of each drawn row ``(draw, rid)``, in proportion to its items that ``covered(rid, item)`` lacks.

    A row without any such item raises ``NoMoreSamples``."""
    rows = drawn.select("rid").distinct()
    weights = uncovered(assign.join(rows, "rid", "left_semi"), space, covered).groupBy("rid", "sid").agg(F.count("*").alias("w"))
    if not rows.join(weights, "rid", "left_anti").isEmpty():
        raise NoMoreSamples("a row has no uncovered item")
    score = F.ln("w") - F.ln(-F.ln(uniform(F.lit(seed), F.col("draw"), F.col("rid"), F.col("sid"))))
    return drawn.join(weights, "rid").groupBy("draw", "rid").agg(F.max_by("sid", F.struct(score, F.col("sid"))).alias("sid"))
