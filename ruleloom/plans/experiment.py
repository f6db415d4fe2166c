"""Training with evaluation, tables of runs, and comparisons of samplers."""

from __future__ import annotations

import itertools
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import evaluation, graph, rules, sampling, sets
from ruleloom.plans import greedy
from ruleloom.sources.relations import Dataset


def train_and_evaluate_any(train: Dataset, test: Dataset, model) -> dict:
    """The eight metrics on ``test`` of any object with ``fit(data)`` and ``predict(data) -> cells``."""
    model.fit(train)
    return evaluation.report(model.predict(test), test.y, test.vocab_y, test.n).first().asDict()


def train_and_evaluate(train: Dataset, test: Dataset, config: greedy.Config) -> dict:
    """The eight metrics on ``test`` with the coverage and number of the rules learned on ``train``."""
    model = greedy.Learner(config)
    scores = train_and_evaluate_any(train, test, model)
    found = model.rules(train.x.sparkSession)
    covered = rules.coverage_ratio(rules.rectangles(found, train.x, train.y), train.y).first()[0]
    return scores | {"coverage": covered, "n_rules": len(model.selected.steps)}


def record(spark: SparkSession, path: str, values: dict, kind: str = "metric", run: str | None = None) -> str:
    """Append ``run, kind, key, value`` rows to a Parquet table; returns the run's name."""
    run = run or uuid.uuid4().hex
    spark.createDataFrame([(run, kind, k, str(v)) for k, v in values.items()], "run string, kind string, key string, value string").write.mode("append").parquet(path)
    return run


def wide_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run with a column per key."""
    return runs.groupBy("run").pivot("key", keys).agg(F.first("value"))


def ranked_groups(runs: DataFrame, groups: list[str], metric: str) -> DataFrame:
    """``groups, mean, std, runs`` of a metric over the runs with equal values of ``groups``, best mean first."""
    wide = wide_runs(runs, [*groups, metric]).withColumn(metric, F.col(metric).cast("double"))
    return wide.groupBy(*groups).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("runs")).orderBy(F.desc("mean"), *groups)


def grid(**choices: list) -> list[greedy.Config]:
    """Every combination of parameter values."""
    return [greedy.Config(**dict(zip(choices, values, strict=True))) for values in itertools.product(*choices.values())]


def repeats(train: Dataset, test: Dataset, configs: list[greedy.Config], times: int = 1, workers: int = 4) -> list[tuple[greedy.Config, int, dict]]:
    """``config, seed, scores`` of every configuration under ``times`` seeds; the jobs of up to ``workers`` runs are on the cluster at once."""
    work = [(c, c.seed + k) for c in configs for k in range(times)]
    with ThreadPoolExecutor(workers) as pool:
        scores = list(pool.map(lambda job: train_and_evaluate(train, test, greedy.Config(**(asdict(job[0]) | {"seed": job[1]}))), work))
    return [(c, seed, s) for (c, seed), s in zip(work, scores, strict=True)]


def search(train: Dataset, dev: Dataset, configs: list[greedy.Config], metric: str = "micro_f1", times: int = 1, workers: int = 4) -> list[tuple[float, greedy.Config]]:
    """Configurations with their mean score on ``dev``, best first, in the order given where equal."""
    found = repeats(train, dev, configs, times, workers)
    means = [(sum(s[metric] for c, _, s in found if c is config) / times, config) for config in configs]
    return sorted(means, key=lambda p: -p[0])


def compare_tail_samplers(y: DataFrame, vocab: DataFrame, n: int, least: float, draws: int, seed: int) -> DataFrame:
    """``sampler, sid, support_size, area, length`` of label sets drawn by uncovered area, by support and uniformly, repeats included."""
    space = graph.sample_space(y, vocab, least)
    assign = sets.containment_division(y, space)
    found = evaluation.tail_report(space.select("sid", "items"), assign, graph.confidence_graph(y), n).select("sid", "support_size", "area", "length")
    ways = {"area": sampling.uncovered_area_distribution(assign, space, y.limit(0)), "frequency": sampling.support_distribution(assign, space),
            "uniform": space.select("sid", F.lit(1.0).alias("w"))}
    parts = [sampling.draw_inverse(w.select("sid", "w"), draws, seed, "sid").select(F.lit(name).alias("sampler"), "sid") for name, w in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(found, "sid").select("sampler", "sid", "support_size", "area", "length")


#: Rows that ``to_markdown`` takes to the driver.
MOST_ROWS = 1000


def to_markdown(table: DataFrame) -> str:
    """A small table as markdown text; more than ``MOST_ROWS`` rows raise ``ValueError``."""
    rows = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    lines = [table.columns, ["---"] * len(table.columns), *([str(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def export(table: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a table as CSV with a header, JSON lines or Parquet, in as many files as it has partitions."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind {kind}")
    getattr(table.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})), kind)(path)
