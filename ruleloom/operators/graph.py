"""Co-occurrence graphs as edge tables, and probable cliques."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.scalar import uniform
from ruleloom.operators.sets import frequency
from ruleloom.sources.scratch import stored


def cooccurrence(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a, b, n``: rows in which item ``a`` of the first and ``b`` of the second relation occur together."""
    return a.select("rid", F.col("item").alias("a")).join(b.select("rid", F.col("item").alias("b")), "rid").groupBy("a", "b").agg(F.count("*").alias("n"))


def confidence_graph(cells: DataFrame) -> DataFrame:
    """Directed edges ``u, v, c, proba`` with proba = rows of both / rows of u; no loops."""
    pairs = cooccurrence(cells, cells).where("a <> b")
    return pairs.join(frequency(cells).withColumnRenamed("item", "a"), "a").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("n").alias("c"), (F.col("n") / F.col("freq")).alias("proba"))


def nodes(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every vocabulary item with its frequency; unused ones stay as isolated nodes."""
    return vocab.join(frequency(cells), "item", "left").select(F.col("item").alias("id"), "name", F.coalesce("freq", F.lit(0)).alias("freq"))


def connectivity_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges ``u < v`` with proba 1 - (1 - p(u,v)) (1 - p(v,u))."""
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("proba").alias("back"))
    return edges.where("u < v").join(back, ["u", "v"]).select("u", "v", (1 - (1 - F.col("proba")) * (1 - F.col("back"))).alias("proba"))


def prune(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("proba") >= least)


def named_subgraph(edges: DataFrame, known: DataFrame, ids: list[int]) -> DataFrame:
    """Edges among ``ids`` with the names and frequencies of both ends."""
    def end(side: str) -> DataFrame:
        return known.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("freq").alias(f"{side}_freq"))

    return edges.where(F.col("u").isin(ids) & F.col("v").isin(ids)).join(end("u"), "u").join(end("v"), "v")


def subgraph_stats(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``sid, size, density, is_clique`` of node sets over directed edges: density is the sum of proba over the size."""
    parts = sets.select("sid", F.size("items").alias("size"), F.explode("items").alias("u"))
    pairs = parts.join(sets.select("sid", F.explode("items").alias("v")), "sid").where("u <> v")
    sums = pairs.join(edges, ["u", "v"], "left").groupBy("sid").agg(F.sum("proba").alias("total"), F.count("proba").alias("k"))
    out = sets.select("sid", F.size("items").alias("size")).join(sums, "sid", "left")
    return out.select("sid", "size", F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("size")).alias("density"), (F.coalesce("k", F.lit(0)) == F.col("size") * (F.col("size") - 1)).alias("is_clique"))


def forms_clique(edges: DataFrame, ids: list[int], node: int) -> bool:
    """Whether an edge leads from every one of ``ids`` to ``node``."""
    return edges.where(F.col("u").isin(ids) & (F.col("v") == node)).select("u").distinct().count() == len(set(ids))


def probable_cliques(ids: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """``items, len, proba`` of all node sets whose edge probabilities multiply to ``least`` or more; single nodes have 1.

    Level by level: a clique grows by a larger neighbour of its last node whose map of smaller neighbours supplies the
    remaining factors. Edges below ``least`` cannot occur and are dropped first.
    """
    kept = prune(edges, least).select("u", "v", "proba").persist()
    adjacent = kept.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("u", "proba"))).alias("adj"))
    level = ids.select(F.array("id").alias("items"), F.col("id").alias("last"), F.lit(1.0).alias("proba"))
    out = level
    while True:  # a clique has no more items than there are nodes
        grown = level.join(kept.select(F.col("u").alias("last"), "v"), "last").join(adjacent, "v")
        factor = F.aggregate("items", F.col("proba"), lambda p, i: p * F.coalesce(F.element_at("adj", i), F.lit(0.0)))
        level = stored(grown.select(F.concat("items", F.array("v")).alias("items"), F.col("v").alias("last"), factor.alias("proba")).where(F.col("proba") >= least))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("items", F.size("items").alias("len"), "proba")


def sample_space(cells: DataFrame, vocab: DataFrame, least: float) -> DataFrame:
    """``sid, items, len, proba``: probable cliques of the connectivity graph, numbered in the order of their items."""
    from pyspark.sql import Window

    found = probable_cliques(vocab.select(F.col("item").alias("id")), connectivity_graph(confidence_graph(cells)), least)
    return found.select((F.row_number().over(Window.orderBy("items")) - 1).cast("int").alias("sid"), "items", "len", "proba")


def walk_cliques(edges: DataFrame, starts: DataFrame, seed: int = 0) -> DataFrame:
    """``start, items``: random clique walks, one per start node.

    At each step every neighbour of the last node passes a trial with the edge's probability, one of those that extend the
    clique is chosen in proportion to it, and the walk ends when none does. A start's walk needs the edges around it only, held as
    maps; the steps are one fold per walk, so walks run side by side.
    """
    edges = stored(edges.select("u", "v", "proba"))
    maps = stored(edges.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("v", "proba"))).alias("adj")))
    level = starts.select(F.col("id").alias("start"), F.array("id").alias("items"), F.col("id").alias("u"))
    done = None
    for step in itertools.count():  # a walk visits no node twice
        near = level.join(maps, "u", "left").withColumn("options", F.filter(F.map_entries("adj"), lambda e: (uniform(F.lit(seed), F.col("start"), F.lit(step), e["key"]) < e["value"]) & ~F.array_contains("items", e["key"])))
        scored = F.transform("options", lambda e: F.struct((F.ln(e["value"]) - F.ln(-F.ln(uniform(F.lit(seed), F.lit("c"), F.col("start"), F.lit(step), e["key"])))).alias("g"), e["key"].alias("v")))
        chosen = near.select("start", "items", F.array_max(scored)["v"].alias("v"))
        pairs = chosen.where("v IS NOT NULL").select("start", "items", "v", F.explode("items").alias("u"))
        good = pairs.join(edges.select("u", "v").distinct(), ["u", "v"]).groupBy("start", "v").agg(F.count("*").alias("k"), F.first("items").alias("items")).where("k = size(items)")
        grown = good.select("start", F.concat("items", F.array("v")).alias("items"), F.col("v").alias("u")).transform(stored)
        stopped = level.join(grown.select("start"), "start", "left_anti").select("start", "items")
        done = stopped if done is None else done.unionByName(stopped)
        if grown.isEmpty():
            return done
        level = grown


def neighbour_lists(together: DataFrame) -> DataFrame:
    """``a, items, counts``: what occurs with each item, the rarest pair first, ties to the smaller item."""
    pairs = F.array_sort(F.collect_list(F.struct("n", "b")))
    own = together.where("a <> b").groupBy("a").agg(pairs.alias("p"))
    return own.select("a", F.transform("p", lambda x: x["b"]).alias("items"), F.transform("p", lambda x: x["n"]).alias("counts"))
