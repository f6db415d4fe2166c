"""Shared helpers of the training-data operators: input, scratch tables, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.sources.scratch import release, stored

__all__ = ["arrow_schema", "batch_map", "components", "documents", "labels", "shuffle_width", "stored"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batch_map(df: DataFrame, fn: Callable[..., dict], schema: str, *args) -> DataFrame:
    """``fn(columns: list of Arrow arrays, *args) -> {name: values}`` applied to every Arrow batch of ``df``."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.columns, *args)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, root)`` with the smallest reachable id as root.

    Alternates the large-star and small-star contractions, each a map-side combined minimum and a join that
    adaptive execution can split at a hub. Every round is written to the shared scratch folder, so a lost
    executor costs one round at most, and deletes the one before. Self loops and repeated edges are harmless; nodes without edges are
    not returned.
    """

    def shape(frame: DataFrame) -> tuple:
        own = F.xxhash64("u", "v")
        return tuple(frame.agg(F.count("*"), F.bit_xor(own), F.sum(own.cast("decimal(38,0)"))).first())

    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = shape(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, current = current, stored(small)
        release(last)
        after = shape(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
