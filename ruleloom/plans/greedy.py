"""Greedy selection of small, diverse rule sets from candidates, prediction, and persistence.

Only one row per step reaches the driver; candidates' rectangles stay distributed and are written to the shared
scratch folder once.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import graph, rules, sampling, sets
from ruleloom.operators.sampling import NoMoreSamples
from ruleloom.sources.scratch import release, stored


class InsufficientCandidates(Exception):
    """Fewer candidates than rules asked for."""


@dataclass
class Config:
    """Parameters of the learners; ``version`` is v1, v2, v3 or submod."""

    version: str = "v1"
    min_feature_proba: float = 0.8
    min_label_proba: float = 0.8
    lambd: float = 10.0
    n_tails: int = 100
    n_heads: int = 10
    n_max_rules: int | None = None
    tolerance: float = 1e-3
    seed: int = 12345


#: Defaults by version, as the factories of the learners have them.
DEFAULTS: dict[str, dict] = {
    "v1": {"n_tails": 100, "n_heads": 10, "lambd": 10.0, "tolerance": 1e-3},
    "v2": {"n_tails": 10, "n_heads": 1, "lambd": 10.0, "n_max_rules": 10},
    "v3": {"n_tails": 10, "n_heads": 1, "lambd": 10.0, "n_max_rules": 10},
    "submod": {"n_tails": 10, "n_heads": 1, "lambd": 10.0, "n_max_rules": 10},
}


def configured(version: str, **changes) -> Config:
    """The defaults of a version with ``changes``; an unknown version raises ``ValueError``."""
    if version not in DEFAULTS:
        raise ValueError(f"unknown version {version}; known are " + ", ".join(DEFAULTS))
    return Config(version=version, **(DEFAULTS[version] | changes))


class Learner:
    """``fit`` and ``predict`` of one configuration on datasets."""

    def __init__(self, config: Config):
        self.config, self.selected = config, Selected()

    def fit(self, train) -> Learner:
        self.selected = fit(train.x, train.y, train.vocab_x, train.vocab_y, train.n, self.config)
        return self

    def rules(self, spark: SparkSession) -> DataFrame:
        return self.selected.frame(spark).select("rule_id", "head", "tail")

    def predict(self, data) -> DataFrame:
        return predict(data.x, self.rules(data.x.sparkSession))


def learner(version: str, **changes) -> Learner:
    """A learner with a version's defaults and ``changes``."""
    return Learner(configured(version, **changes))


#: Objective of a rule by version, from columns mc (marginal coverage), kl and div (sum of distances to the selected).
OBJECTIVES: dict[str, Callable[[float], Column]] = {
    "v1": lambda lambd: F.col("mc") * F.col("kl") + F.lit(lambd) * F.col("div"),
    "v2": lambda lambd: F.col("mc") * F.col("kl") + F.lit(lambd) * F.col("div"),
    "v3": lambda lambd: F.sqrt(F.col("mc").cast("double")) * F.col("kl") + F.lit(lambd) * F.col("div"),
    "submod": lambda lambd: F.when(F.col("mc") > 0, F.col("kl")).otherwise(F.lit(0.0)) + F.lit(lambd) * F.col("mc"),
}


@dataclass
class Selected:
    """Chosen rules in order, with objective and marginal coverage of each step."""

    steps: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["step"], s["rule_id"], s["head"], s["tail"], s["objective"], s["mc"]) for s in self.steps], "step int, rule_id long, head array<int>, tail array<int>, objective double, mc long")


def step_scores(stats: DataFrame, cells: DataFrame, covered: DataFrame, diversity: DataFrame, config: Config) -> DataFrame:
    """All candidates with marginal coverage, summed distance to the selected, and objective."""
    mc = rules.marginal_coverage(cells, covered)
    joined = stats.join(mc, "rule_id", "left").join(diversity, "rule_id", "left").withColumn("mc", F.coalesce("uncovered", F.lit(0))).withColumn("div", F.coalesce("div", F.lit(0.0)))
    return joined.withColumn("objective", OBJECTIVES[config.version](config.lambd).cast("double"))


def _distance_to(cells: DataFrame, own: DataFrame, size: int, areas: DataFrame) -> DataFrame:
    """``rule_id, d``: rectangle distance of each candidate to one selected rule."""
    shared = cells.join(own, ["rid", "item"], "left_semi").groupBy("rule_id").agg(F.count("*").alias("i"))
    return areas.join(shared, "rule_id", "left").select("rule_id", (1 - F.coalesce(F.try_divide("i", F.col("a") + F.lit(size) - F.col("i")), F.lit(0.0))).alias("d"))


def select(candidates: DataFrame, x: DataFrame, y: DataFrame, n: int, config: Config, budget: int, distinct: bool = True) -> Selected:
    """Pick up to ``budget`` rules of ``candidates(rule_id, head, tail)``: the best objective each step, ties by tail, then head.

    Stops early at a marginal coverage ratio of ``tolerance`` or less when ``n_max_rules`` is not set. Without ``distinct`` a
    rule may be chosen again.
    """
    stats = rules.statistics(candidates, x, y, n).select("rule_id", "head", "tail", "kl")
    stats, cells = stored(stats), stored(rules.rectangles(candidates, x, y))
    areas = stored(stats.select("rule_id").join(cells.groupBy("rule_id").agg(F.count("*").alias("a")), "rule_id", "left").fillna(0, ["a"]))
    total = y.count()
    covered, diversity, out = cells.select("rid", "item").limit(0), stats.select("rule_id", F.lit(0.0).alias("div")), Selected()
    for step in range(budget):
        open_rules = stats if not distinct or not out.steps else stats.where(~F.col("rule_id").isin([s["rule_id"] for s in out.steps]))
        best = step_scores(open_rules, cells, covered, diversity, config).orderBy(F.desc("objective"), "tail", "head").limit(1).collect()
        if not best:
            if config.n_max_rules and step < config.n_max_rules:
                raise InsufficientCandidates(f"{step} candidates for {config.n_max_rules} rules")
            break
        row = best[0].asDict()
        if config.n_max_rules is None and row["mc"] <= config.tolerance * total:
            break
        out.steps.append({"step": step} | {k: row[k] for k in ("rule_id", "head", "tail", "objective", "mc")})
        own = cells.where(F.col("rule_id") == row["rule_id"]).select("rid", "item")
        d = _distance_to(cells, own, own.count(), areas)
        diversity = diversity.join(d, "rule_id").select("rule_id", (F.col("div") + F.col("d")).alias("div"))
        covered = cells.where(F.col("rule_id").isin([s["rule_id"] for s in out.steps])).select("rid", "item").distinct()
        if (step + 1) % 8 == 0:
            diversity = stored(diversity)  # the chain of sums is cut every few steps
    return out


def set_objective(selected: DataFrame, x: DataFrame, y: DataFrame, n: int, lambd: float, against_itself: bool = False) -> float:
    """Sum of sequential coverage times divergence plus ``lambd`` times the sum of pair distances.

    ``against_itself`` takes coverage relative to the whole set, as older results did, which leaves the distances only.
    """
    cells = rules.rectangles(selected, x, y).persist()
    spread = rules.distances(cells, selected).agg(F.sum("distance")).first()[0] or 0.0
    if against_itself:
        return lambd * spread
    first = cells.groupBy("rid", "item").agg(F.min("rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("mc"))
    gained = rules.statistics(selected, x, y, n).join(first, "rule_id").agg(F.sum(F.col("mc") * F.col("kl"))).first()[0] or 0.0
    return gained + lambd * spread


@dataclass
class Spaces:
    """Sample spaces of features and labels, and the rows that contain their sets; built once for all rounds."""

    x: DataFrame
    x_rows: DataFrame
    y: DataFrame
    y_rows: DataFrame


def spaces(x: DataFrame, y: DataFrame, vocab_x: DataFrame, vocab_y: DataFrame, config: Config) -> Spaces:
    own = []
    for cells, vocab, least in ((x, vocab_x, config.min_feature_proba), (y, vocab_y, config.min_label_proba)):
        space = stored(graph.sample_space(cells, vocab, least))
        own += [space, stored(sets.containment_division(cells, space))]
    return Spaces(*own)


def candidates(own: Spaces, n: int, covered: DataFrame, config: Config, round_: int = 0) -> DataFrame:
    """``rule_id, head, tail``: tails drawn by uncovered area, then heads for each tail by the discriminative distribution; repeated
    draws are one rule. Tails that all rows have give none."""
    weights = sampling.uncovered_area_distribution(own.y_rows, own.y, covered)
    if weights.where("w > 0").isEmpty():
        raise NoMoreSamples("all labels are covered")
    tails = sampling.draw_inverse(weights.select("sid", "w"), config.n_tails, config.seed + round_, "sid").select("sid").distinct()
    tail_rows = own.y_rows.join(tails, "sid").select("rid", F.col("sid").alias("item"))
    found = sampling.head_distribution(own.x_rows, tail_rows, n).select("tail", "sid", "w")
    heads = sampling.draw_per_group(found, config.n_heads, config.seed + round_, "tail", "sid").select("tail", "sid").distinct()
    out = heads.join(own.x.select("sid", F.col("items").alias("head")), "sid").join(own.y.select(F.col("sid").alias("tail"), F.col("items").alias("t")), "tail")
    return rules.canonical(out.select(F.xxhash64("head", "t").alias("rule_id"), "head", F.col("t").alias("tail")))


def _spread(cells: DataFrame, areas: DataFrame, chosen: DataFrame, n_chosen: int) -> DataFrame:
    """``rule_id, div``: summed rectangle distance of candidates to ``chosen(step, rid, item)``. A pair that shares no cell has distance 1, so
    only pairs that share some are met."""
    sizes = chosen.groupBy("step").agg(F.count("*").alias("b"))
    shared = cells.join(chosen, ["rid", "item"]).groupBy("rule_id", "step").agg(F.count("*").alias("i")).join(sizes, "step").join(areas, "rule_id")
    alike = shared.groupBy("rule_id").agg(F.sum(F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("s"))
    return areas.join(alike, "rule_id", "left").select("rule_id", (F.lit(float(n_chosen)) - F.coalesce("s", F.lit(0.0))).alias("div"))


class Choice:
    """Rules chosen so far and the label cells of each."""

    def __init__(self, x: DataFrame, y: DataFrame, n: int, config: Config):
        self.x, self.y, self.n, self.config, self.selected = x, y, n, config, Selected()
        self.cells = stored(y.limit(0).select(F.lit(0).alias("step"), "rid", "item"))

    def covered(self) -> DataFrame:
        return self.cells.select("rid", "item").distinct()

    def described(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Divergence and rectangles of candidates, for one or more choices among them."""
        stats = rules.statistics(found, self.x, self.y, self.n).select("rule_id", "head", "tail", "kl")
        return stored(stats), stored(rules.rectangles(found, self.x, self.y))

    def best(self, stats: DataFrame, cells: DataFrame) -> dict | None:
        """The candidate of the best objective, ties (to nine digits) by tail, then head."""
        areas = stats.select("rule_id").join(cells.groupBy("rule_id").agg(F.count("*").alias("a")), "rule_id", "left").fillna(0, ["a"])
        spread = _spread(cells, areas, self.cells, len(self.selected.steps))
        scored = step_scores(stats, cells, self.covered(), spread, self.config)
        found = scored.withColumn("objective", F.round("objective", 9)).orderBy(F.desc("objective"), "tail", "head").limit(1).collect()
        return found[0].asDict() if found else None

    def add(self, row: dict, cells: DataFrame) -> None:
        step = len(self.selected.steps)
        self.selected.steps.append({"step": step} | {k: row[k] for k in ("rule_id", "head", "tail", "objective", "mc")})
        own = cells.where(F.col("rule_id") == row["rule_id"]).select(F.lit(step).alias("step"), "rid", "item")
        before = self.cells
        self.cells = stored(before.unionByName(own))
        release(before)


def first_round(own: Spaces, x: DataFrame, y: DataFrame, n: int, config: Config) -> tuple[Selected, DataFrame | None]:
    """Chosen rules, and all candidates met.

    Each step draws candidates against the coverage so far and adds the best of them. It ends at ``n_max_rules``, when all labels are
    covered, or, for v1 without ``n_max_rules``, when the best candidate covers a share of ``tolerance`` or less of the label cells."""
    choice, pool = Choice(x, y, n, config), None
    total = y.count()
    for k in itertools.count():
        if config.n_max_rules is not None and k >= config.n_max_rules:
            break
        try:
            fresh = stored(candidates(own, n, choice.covered(), config, k))
        except NoMoreSamples:
            break
        pool = fresh if pool is None else stored(rules.canonical(pool.unionByName(fresh)))
        stats, cells = choice.described(fresh)
        row = choice.best(stats, cells)
        if row is None or config.version == "v1" and config.n_max_rules is None and row["mc"] <= config.tolerance * total:
            break
        choice.add(row, cells)
        release(stats, cells)
    return choice.selected, pool


def second_round(pool: DataFrame | None, budget: int, x: DataFrame, y: DataFrame, n: int, config: Config, distinct: bool = False) -> Selected:
    """``budget`` rules chosen anew from all candidates; one may be chosen again unless ``distinct``. No candidates raise ``InsufficientCandidates``."""
    if pool is None or pool.isEmpty():
        raise InsufficientCandidates("no candidates")
    choice = Choice(x, y, n, config)
    stats, cells = choice.described(pool)
    for _ in range(budget):
        taken = [s["rule_id"] for s in choice.selected.steps]
        row = choice.best(stats.where(~F.col("rule_id").isin(taken)) if distinct and taken else stats, cells)
        if row is None:
            break
        choice.add(row, cells)
    return choice.selected


def fit(x: DataFrame, y: DataFrame, vocab_x: DataFrame, vocab_y: DataFrame, n: int, config: Config) -> Selected:
    """Learn a rule set: ``first_round``, and for v1 a ``second_round`` from all candidates, of which the set with the better objective is
    kept, the second one where they are equal."""
    own = spaces(x, y, vocab_x, vocab_y, config)
    chosen, pool = first_round(own, x, y, n, config)
    if config.version != "v1" or not chosen.steps:
        return chosen
    again = second_round(pool, len(chosen.steps), x, y, n, config)
    value = [set_objective(s.frame(x.sparkSession).select("rule_id", "head", "tail").dropDuplicates(["rule_id"]), x, y, n, config.lambd) for s in (chosen, again)]
    return chosen if value[0] > value[1] else again


def predict(x: DataFrame, model: DataFrame) -> DataFrame:
    """``rid, item``: union of the tails of all rules ``(rule_id, head, tail)`` whose head a row contains."""
    return rules.covers(x, model, "head").join(model.select("rule_id", F.explode("tail").alias("item")), "rule_id").select("rid", "item").distinct()


def save(model: Selected, config: Config, spark: SparkSession, path: str) -> None:
    """Rules as Parquet and parameters as JSON text below ``path``."""
    model.frame(spark).write.mode("overwrite").parquet(f"{path}/rules")
    spark.createDataFrame([(json.dumps(config.__dict__),)], "value string").write.mode("overwrite").text(f"{path}/params")


def load(spark: SparkSession, path: str) -> tuple[Selected, Config]:
    steps = [r.asDict() for r in spark.read.parquet(f"{path}/rules").orderBy("step").collect()]
    return Selected(steps), Config(**json.loads(spark.read.text(f"{path}/params").first()[0]))
