"""Biclusters of a binary relation: projection, clustering, majority votes, blocks and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions.scalar import rounding_threshold

__all__ = ["adjacency", "blocks", "cluster_rows", "best_densities", "density_estimate", "majority_vote", "pcv", "permutation", "rounding_threshold"]


def cluster_rows(cells: DataFrame, n_items: int, k: int, seed: int = 1) -> DataFrame:
    """``rid, cluster``: k-means on the rows' projection to ``k`` principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    one = F.transform(F.sequence(F.lit(0), F.lit(n_items - 1)), lambda i: F.array_contains("items", i).cast("double"))
    rows = cells.groupBy("rid").agg(F.collect_set("item").alias("items")).select("rid", array_to_vector(one).alias("v"))
    low = PCA(k=min(k, n_items), inputCol="v", outputCol="features").fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(low).transform(low).select("rid", "cluster")


def majority_vote(cells: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """``cluster, item`` where more than ``threshold`` of the cluster's rows have the item."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return cells.join(clusters, "rid").groupBy("cluster", "item").agg(F.count("*").alias("n")).join(size, "cluster").where(F.col("n") > threshold * F.col("size")).select("cluster", "item")


def pcv(cells: DataFrame, n_items: int, k: int, threshold: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Row clusters and their items by vote."""
    rows = cluster_rows(cells, n_items, k, seed)
    return rows, majority_vote(cells, rows, threshold)


def density_estimate(cells: DataFrame, items: DataFrame, n_rows: int, steps: int) -> DataFrame:
    """``p, q, inside, outside, gap, size`` over a grid of densities with p above q: columns with more ones than the rounding threshold of p and q
    make the cluster, ``inside`` and ``outside`` are the densities observed then, ``gap`` is their distance to p and q.

    Without columns inside (outside) the density is 1 (0). ``best_densities`` takes the least gap. The grid is a parameter and meets one row per column.
    """
    spark = cells.sparkSession
    grid = spark.range(1, steps).select((F.col("id") / steps).alias("p"))
    grid = grid.crossJoin(grid.withColumnRenamed("p", "q")).where("p > q")
    share = F.ln((1 - F.col("q")) / (1 - F.col("p"))) / F.ln(F.col("p") * (1 - F.col("q")) / (F.col("q") * (1 - F.col("p"))))
    ones = items.select("item").join(cells.groupBy("item").agg(F.count("*").alias("n")), "item", "left").fillna(0, ["n"])
    met = ones.crossJoin(F.broadcast(grid.withColumn("cut", share))).withColumn("own", F.col("n") > F.round(F.col("cut") * n_rows, 6))
    sums = met.groupBy("p", "q").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("i"), F.sum("n").alias("all"), F.count_if("own").alias("size"), F.count("*").alias("k"))
    inside = F.when(F.col("size") > 0, F.col("i") / (F.col("size") * n_rows)).otherwise(F.lit(1.0))
    outside = F.when(F.col("size") < F.col("k"), (F.col("all") - F.col("i")) / ((F.col("k") - F.col("size")) * n_rows)).otherwise(F.lit(0.0))
    out = sums.select("p", "q", inside.alias("inside"), outside.alias("outside"), "size")
    return out.withColumn("gap", F.abs(F.col("p") - F.col("inside")) + F.abs(F.col("q") - F.col("outside")))


def best_densities(grid: DataFrame) -> DataFrame:
    """The row of the least gap, ties to the smaller p, then q."""
    return grid.orderBy(F.round("gap", 9), "p", "q").limit(1)


def blocks(members: DataFrame) -> DataFrame:
    """``block, clusters, ids``: members ``(id, cluster)`` that belong to the same clusters."""
    own = members.groupBy("id").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    grouped = own.groupBy("clusters").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select((F.row_number().over(Window.orderBy("clusters")) - 1).cast("int").alias("block"), "clusters", "ids")


def adjacency(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, area`` of row and column blocks that share a cluster."""
    a = left.select(F.col("block").alias("l"), F.size("ids").alias("nl"), F.explode("clusters").alias("c"))
    b = right.select(F.col("block").alias("r"), F.size("ids").alias("nr"), F.explode("clusters").alias("c"))
    return a.join(b, "c").select("l", "r", (F.col("nl") * F.col("nr")).cast("long").alias("area")).distinct()


def importance(pairs: DataFrame, side: str) -> DataFrame:
    """``block, score``: summed area of a block's adjacent blocks."""
    return pairs.groupBy(F.col(side).alias("block")).agg(F.sum("area").alias("score"))


MOST_BLOCKS = 500


def block_order(found: DataFrame, pairs: DataFrame, side: str) -> list[int]:
    """Blocks by importance, each inserted beside the neighbour it shares most clusters with (Jaccard). 

    The order is worked out on the driver, so more than ``MOST_BLOCKS`` blocks raise ``ValueError``."""
    if found.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks")
    other = "r" if side == "l" else "l"
    rows = pairs.select(F.col(side).alias("b"), F.col(other).alias("o"), "area").collect()
    near: dict[int, set] = {r["block"]: set() for r in found.select("block").collect()}
    score = dict.fromkeys(near, 0)
    for r in rows:
        near[r["b"]].add(r["o"])
        score[r["b"]] += r["area"]

    def alike(a: int, b: int) -> float:
        union = near[a] | near[b]
        return len(near[a] & near[b]) / len(union) if union else 0.0

    order: list[int] = []
    for block in sorted(near, key=lambda b: (-score[b], b)):
        gains = [(alike(block, order[i - 1]) if i else 0) + (alike(block, order[i]) if i < len(order) else 0) for i in range(len(order) + 1)]
        order.insert(max(range(len(gains)), key=lambda i: (gains[i], i)), block)
    return order


def permutation(found: DataFrame, order: list[int], everyone: DataFrame) -> DataFrame:
    """``id, place``: members in block order, those of no block at the end.

    Places come from counts of members per block and range of ids, so no task sees all members; a block's members and those without one stand in
    order of their ids."""
    rank = found.sparkSession.createDataFrame(list(enumerate(order)), "rank int, block int")
    # as many rows as the order, at most MOST_BLOCKS
    placed = everyone.join(found.join(F.broadcast(rank), "block").select("rank", F.explode("ids").alias("id")), "id", "left")
    ranked = placed.select("id", F.coalesce("rank", F.lit(len(order))).alias("rank"), F.floor(F.col("id") / 65536).alias("part"))
    counts = ranked.groupBy("rank", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("rank", "part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("rank", "part").orderBy("id")) - 1
    return ranked.withColumn("at", inside).join(before, ["rank", "part"]).select("id", (F.col("before") + F.col("at")).alias("place"))


def permuted(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells at their permuted places."""
    return cells.join(rows.select(F.col("id").alias("rid"), F.col("place").alias("row")), "rid").join(columns.select(F.col("id").alias("item"), F.col("place").alias("col")), "item").select("row", "col")


def painted(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """``rid, item, cluster`` of the low-rank matrix: the cells of each bicluster ``clusters(rid, cluster)`` times ``items(cluster, item)``; the
    smallest cluster paints a cell that several hold."""
    return clusters.join(items, "cluster").groupBy("rid", "item").agg(F.min("cluster").alias("cluster"))
