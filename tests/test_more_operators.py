"""Readers, generators, draws, updates, orderings and experiments against plain Python."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import scalar
from ruleloom.operators import bicluster, evaluation, rules, sampling, sets
from ruleloom.plans import experiment, greedy
from ruleloom.sources import arff, relations, scratch

from .test_goldens import cells


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_quantiles_are_exact(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.choice([None, rng.random() ** 9 * 1e6, float(rng.randint(0, 5))])) for _ in range(900)] + [("z", 0, None), ("y", 0, 4.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {tuple(r[k] for k in keys): (r["p10"], r["p50"], r["p99"]) for r in evaluation.quantiles(df, keys, "v", [0.1, 0.5, 0.99], buckets=16).collect()}
    own: dict = {}
    for g, h, v in rows:
        if v is not None:
            own.setdefault(tuple({"g": g, "h": h}[k] for k in keys), []).append(v)

    def plain(values, q):
        values = sorted(values)
        at = q * (len(values) - 1)
        low = values[int(at)]
        return low if at == int(at) else low + (values[int(at) + 1] - low) * (at - int(at))

    assert set(got) == set(own)
    for key, values in own.items():
        assert got[key] == pytest.approx([plain(values, q) for q in (0.1, 0.5, 0.99)], rel=1e-12)
    described = {tuple(r[k] for k in keys): r for r in evaluation.describe(df, keys, "v").collect()}
    for key, values in own.items():
        assert described[key]["count"] == len(values) and described[key]["mean"] == pytest.approx(statistics.mean(values))
    # without keys there is one row, of nulls for no values
    assert [r["p50"] for r in evaluation.quantiles(df.limit(0), keys, "v", [0.5]).collect()] == [None] * (not keys)


def test_filled_subsets_are_equally_likely(spark):
    df = spark.range(8000).withColumn("items", F.expr("array(4, 6, 9)"))
    got = Counter(tuple(r[0]) for r in df.select(scalar.filled_subset(F.col("items"), F.lit(1), F.col("id"))).collect())
    assert len(got) == 7 and all(abs(n - 8000 / 7) < 140 for n in got.values())
    one = spark.createDataFrame([([3],), ([],), (list(range(2000)),)], "items array<int>").select(scalar.filled_subset(F.col("items"), F.lit(2)).alias("s")).collect()
    assert one[0]["s"] == [3] and one[1]["s"] is None and len(one[2]["s"]) > 900


def test_binomial(spark):
    import math

    grid = spark.range(12).selectExpr("int(id) AS n").crossJoin(spark.range(-1, 14).selectExpr("int(id) AS k"))
    assert all(r["b"] == (math.comb(r["n"], r["k"]) if 0 <= r["k"] <= r["n"] else 0) for r in grid.withColumn("b", scalar.binomial(F.col("n"), F.col("k"))).collect())


def test_power_sets_of_long_rows_are_refused(spark):
    with pytest.raises(Exception, match="more than 20 items"):
        spark.range(1).select(scalar.powerset(F.sequence(F.lit(1), F.lit(21)))).collect()


@pytest.mark.parametrize("area", [False, True])
def test_drawn_patterns_follow_support(spark, area):
    own = {0: (1, 2, 3), 1: (2, 3), 2: (7,), 3: ()}
    rows = spark.createDataFrame([(r, list(s)) for r, s in own.items()], "rid long, items array<int>")
    got = Counter(tuple(r["items"]) for r in sampling.draw_row_patterns(rows, 6000, 5, area).collect())
    subsets = lambda s: [tuple(x for i, x in enumerate(s) if m >> i & 1) for m in range(1, 1 << len(s))]
    want = Counter(p for s in own.values() for p in subsets(s))
    want = {p: n * (len(p) if area else 1) for p, n in want.items()}
    assert sum(got.values()) == 6000 and set(got) == set(want)
    assert all(abs(got[p] / 6000 - n / sum(want.values())) < 0.03 for p, n in want.items())


def test_rows_of_thousands_of_items_have_weights(spark):
    rows = spark.createDataFrame([(0, list(range(3000))), (1, list(range(2999))), (2, [1])], "rid long, items array<int>")
    w = {r["rid"]: r["w"] for r in sampling.row_pattern_weights(rows).collect()}
    assert w[0] == pytest.approx(1) and w[1] == pytest.approx(0.5) and w[2] == 0
    assert sampling.draw_row_patterns(rows, 20, 1).count() == 20


def test_pair_draws_follow_differences(spark):
    own = {0: {1, 2}, 1: {2}, 2: {1, 2, 5}, 3: {2}, 4: {5}, 5: set(), 6: {1, 2, 5}}
    target = {0, 1, 2}
    x = spark.createDataFrame([(r, i) for r, s in own.items() for i in s], "rid long, item int")
    got = sampling.pair_draws(x, spark.range(3).toDF("rid"), spark.range(7).toDF("rid"), 4000, 3, buckets=4).collect()
    want = {(p, n): len(own[p] - own[n]) for p in target for n in own if n not in target and own[p] - own[n]}
    seen = Counter((r["pos"], r["neg"]) for r in got)
    assert len(got) == 4000 and set(seen) == set(want) and all(r["item"] in own[r["pos"]] - own[r["neg"]] for r in got)
    assert all(abs(seen[p] / 4000 - w / sum(want.values())) < 0.03 for p, w in want.items())


def test_updates_and_draws_inside_rows(spark):
    space = spark.createDataFrame([(0, [0]), (1, [1]), (2, [0, 1])], "sid int, items array<int>")
    assign = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (2, 1)], "rid long, sid int")
    rows, none = spark.range(3).toDF("rid"), spark.createDataFrame([], "rid long, item int")
    counters = sampling.element_counters(assign, space, none)
    w = lambda c: [r["w"] for r in sampling.counter_weights(c, rows).orderBy("rid").collect()]
    assert w(counters) == [4, 1, 1]
    once = sampling.counters_after(counters, rows.where("rid < 2"), [0])
    assert w(once) == w(sampling.counters_after(once, rows.where("rid < 2"), [0])) == [2, 0, 1]
    naive = sampling.row_weights(assign, space, none, rows)
    for expected in ([2, 0, 1], [0, -1, 1]):
        naive = sampling.weights_after_naive(naive, assign, space, rows.where("rid < 2"), [0])
        assert [r["w"] for r in naive.orderBy("rid").collect()] == expected
    covered = spark.createDataFrame([(0, 0)], "rid long, item int")
    drawn = spark.range(3000).selectExpr("id AS draw", "0L AS rid")
    got = Counter(r["sid"] for r in sampling.sets_in_rows(drawn, assign, space, covered, 4).collect())
    assert set(got) == {1, 2} and abs(got[1] / 3000 - 0.5) < 0.04
    with pytest.raises(sampling.NoMoreSamples):
        sampling.sets_in_rows(drawn, assign, space, spark.createDataFrame([(0, 0), (0, 1)], "rid long, item int"), 4)


def test_rules_are_validated(spark):
    d = relations.toy(spark)
    table = spark.createDataFrame([(0, [0], [0]), (1, [0, 1, 2], [1])], "rule_id long, head array<int>, tail array<int>")
    assert [r["rule_id"] for r in rules.validated(table, d.x, d.vocab_x, d.vocab_y).collect()] == [0]
    with pytest.raises(ValueError):
        rules.validated(spark.createDataFrame([(0, [9], [0])], table.schema), d.x, d.vocab_x, d.vocab_y)


def test_csv_without_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,a,0.5\n2,b,\n3,a,1.5\n")
    table = relations.read_csv(spark, str(path))
    assert table.columns == ["rid", "c0", "c1", "c2"] and [tuple(r)[1:] for r in table.orderBy("rid").collect()] == [(1, "a", 0.5), (2, "b", None), (3, "a", 1.5)]


XML = '<?xml version="1.0"?><labels xmlns="http://a.b"><label name="l"/><label name="m"/></labels>'


def test_arff_folders(spark, tmp_path):
    head = "@relation r\n@attribute l {0,1}\n@attribute a numeric\n@attribute 'b c' {u,v,w}\n@attribute m {NO,YES}\n@data\n"
    folder = tmp_path / "birds"
    folder.mkdir()
    (folder / "birds-train.arff").write_text(head + "1,1.5,u,NO\n0,2.5,v,YES\n0,-3,w,NO\n")
    (folder / "birds-test.arff").write_text(head + "1,9,w,YES\n")
    (folder / "birds.xml").write_text(XML)
    train, test = relations.load(spark, "birds", str(tmp_path))
    names = lambda d, cells, vocab: sorted(r["name"] for r in cells.join(vocab, "item").collect())
    assert (train.n, test.n) == (3, 1) and names(train, train.y, train.vocab_y) == ["l", "m"] and names(test, test.y, test.vocab_y) == ["l", "m"]
    assert names(train, train.x, train.vocab_x) == ["a", "b c=u", "b c=v", "b c=w"]
    assert {r["item"]: r["freq"] for r in relations.label_frequency(train).collect()} == {0: 1, 1: 1}
    train.check()
    one = tmp_path / "whole"
    one.mkdir()
    (one / "whole.arff").write_text(head + "".join(f"{i % 2},{i},u,YES\n" for i in range(40)))
    train, test = relations.load(spark, "whole", str(tmp_path), labels={"l", "m"})
    assert train.n + test.n == 40 and 15 < train.n < 38 and train.y.count() + test.y.count() == 60
    thin = tmp_path / "thin"
    thin.mkdir()
    for part, rows in (("train", "{0 1, 2 1}\n{1 1}\n"), ("test", "{1 1,2 1}\n")):
        (thin / f"thin-{part}.arff").write_text("@relation r\n@attribute a {0,1}\n@attribute b {0,1}\n@attribute l {0,1}\n@data\n" + rows)
    train, test = arff.read_directory(spark, str(thin), 1, sparse=True)
    assert (names(train, train.x, train.vocab_x), names(test, test.x, test.vocab_x), test.y.count()) == (["a", "b"], ["b"], 1)
    with pytest.raises(ValueError):
        arff.read_dense(spark, str(one / "whole.arff"), {"no such label"})
    toy, same = relations.load(spark, "toy")
    assert toy.n == same.n == 3
    with pytest.raises(ValueError):
        relations.load(spark, "birds")


def test_keyed_arff(spark, tmp_path):
    path = tmp_path / "genbase.arff"
    path.write_text("@relation g\n@attribute key string\n@attribute a numeric\n@attribute c {NO,YES}\n@attribute l {0,1}\n@data\np1,1,YES,1\np2,2,NO,0\np3,3,YES,0\n")
    x, y = arff.read_genbase(spark, str(path), 1)
    assert sorted(r["name"] for r in x.collect()) == ["a", "a", "c", "c"] and y.count() == 1


def test_kept_relations_follow_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "aa bb", "en"), (1, "bb", "de")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for t, df in (("documents", docs), ("labels", marks)):
        df.toPandas().to_parquet(tmp_path / f"{t}.parquet")
    first = relations.docs(spark, str(tmp_path))
    assert first.n == 2 and relations.docs(spark, str(tmp_path)) is first
    docs.limit(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert relations.docs(spark, str(tmp_path)).n == 1
    relations.release_docs()


def test_scratch_tables_are_released(spark):
    import os

    before = scratch.mark()
    one, two = scratch.stored(spark.range(3).toDF("a")), scratch.stored(spark.range(4).toDF("a"))
    scratch.release_since(before, two)
    assert not os.path.exists(one._scratch_path) and two.count() == 4
    scratch.release(two)
    assert not os.path.exists(two._scratch_path)


def blocks_matrix(spark):
    """Two planted biclusters of ten rows and four columns, with a little noise."""
    rng = random.Random(1)
    rows = [[c for c in range(8) if (c < 4) == (r < 10) and rng.random() < 0.95 or rng.random() < 0.02] for r in range(20)]
    return rows, cells(spark, rows)


def test_biclusters_are_found(spark):
    rows, x = blocks_matrix(spark)
    members, items = bicluster.pcv(x, 8, 2, 0.5)
    by_cluster: dict = {}
    for r in members.collect():
        by_cluster.setdefault(r["cluster"], set()).add(r["rid"])
    assert sorted(map(sorted, by_cluster.values())) == [list(range(10)), list(range(10, 20))]
    found: dict = {}
    for r in items.collect():
        found.setdefault(r["cluster"], set()).add(r["item"])
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert bicluster.painted(members, items).count() == 80
    vocab = spark.range(8).selectExpr("int(id) AS item")
    grid = {(round(r["p"], 3), round(r["q"], 3)): r for r in bicluster.density_estimate(x.where("rid < 10"), vocab, 10, 10).collect()}
    ones = Counter(c for r in rows[:10] for c in r)
    own = sum(ones[c] for c in range(4))
    assert (grid[0.8, 0.1]["size"], grid[0.8, 0.1]["inside"], grid[0.8, 0.1]["outside"]) == (4, pytest.approx(own / 40), pytest.approx((sum(ones.values()) - own) / 40))
    best = bicluster.best_densities(bicluster.density_estimate(x.where("rid < 10"), vocab, 10, 10)).first()
    assert best["gap"] == min(r["gap"] for r in grid.values()) and best["size"] == 4


def test_orders_and_permutations(spark):
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (5, 1), (8, 2)], "id long, cluster int")
    found = bicluster.blocks(members).persist()
    assert {tuple(r["clusters"]): r["ids"] for r in found.collect()} == {(0,): [1, 2], (0, 1): [5], (1,): [3, 4], (2,): [8]}
    near = bicluster.adjacency(found, found)
    order = bicluster.block_order(found, near, "l")
    name = {r["block"]: tuple(r["clusters"]) for r in found.collect()}
    shown = [name[b] for b in order]
    assert sorted(shown) == [(0,), (0, 1), (1,), (2,)] and abs(shown.index((0,)) - shown.index((0, 1))) == 1 and abs(shown.index((1,)) - shown.index((0, 1))) == 1
    everyone = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9, 70_000, 10)], "id long")
    places = {r["id"]: r["place"] for r in bicluster.permutation(found, order, everyone).collect()}
    ids = {r["block"]: r["ids"] for r in found.collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda p: p[1])] == [i for b in order for i in ids[b]] + [9, 10, 70_000]
    moved = bicluster.permuted(spark.createDataFrame([(3, 9), (5, 10)], "rid long, item long"), bicluster.permutation(found, order, everyone), bicluster.permutation(found, order, everyone))
    assert pairs(moved) == sorted([(places[3], places[9]), (places[5], places[10])])
    assert bicluster.rounding_threshold(0.8, 0.2) == pytest.approx(0.5)
    many = spark.range(bicluster.MOST_BLOCKS + 1).selectExpr("int(id) AS block", "array(int(id)) AS clusters", "array(id) AS ids")
    with pytest.raises(ValueError):
        bicluster.block_order(many, near, "l")


def planted(spark, n=60, seed=3):
    x, y = relations.synthetic_rules(spark, n, [([0, 1], [0]), ([2, 3], [1])], seed=seed)
    names = lambda k: spark.createDataFrame([(i, str(i)) for i in range(k)], "item int, name string")
    return relations.Dataset(x.persist(), y.persist(), spark.range(n).toDF("rid"), names(4), names(2), n)


def test_experiments(spark, tmp_path):
    train, test = relations.split_dataset(planted(spark), 0.6)
    config = greedy.configured("v2", n_max_rules=2, n_tails=20, n_heads=4, min_feature_proba=0.5, min_label_proba=0.9, lambd=1.0)
    runs = experiment.repeats(train, test, [config], times=2, workers=2)
    assert [s for _, s, _ in runs] == [config.seed, config.seed + 1]
    for k, (_, seed, scores) in enumerate(runs):
        assert scores["n_rules"] == 2 and scores["micro_f1"] > 0.5
        run = experiment.record(spark, str(tmp_path / "runs"), {"version": "v2", "seed": seed}, "param", f"r{k}")
        experiment.record(spark, str(tmp_path / "runs"), {"micro_f1": scores["micro_f1"]}, run=run)
    table = spark.read.parquet(str(tmp_path / "runs"))
    best = experiment.ranked_groups(table, ["version"], "micro_f1").first()
    assert (best["version"], best["runs"]) == ("v2", 2) and best["mean"] == pytest.approx(statistics.mean(s["micro_f1"] for _, _, s in runs))
    assert experiment.wide_runs(table, ["version", "seed"]).count() == 2

    class Majority:
        def fit(self, data):
            self.items = data.y.groupBy("item").count().where(F.col("count") > data.n / 2).select("item")

        def predict(self, data):
            return data.rows.crossJoin(self.items)

    scores = experiment.train_and_evaluate_any(train, test, Majority())
    assert set(scores) == set(evaluation.METRICS) and 0 <= scores["micro_f1"] <= 1
    assert [c.lambd for c in experiment.grid(version=["v2"], lambd=[1.0, 2.0])] == [1.0, 2.0]
    with pytest.raises(ValueError):
        greedy.configured("v9")
    assert (greedy.configured("v1").n_tails, greedy.configured("v3").n_max_rules) == (100, 10)


def test_v1_keeps_the_better_of_two_rounds(spark):
    d = planted(spark)
    config = greedy.configured("v1", n_max_rules=2, n_tails=20, n_heads=4, min_feature_proba=0.5, min_label_proba=0.9, lambd=1.0)
    own = greedy.spaces(d.x, d.y, d.vocab_x, d.vocab_y, config)
    first, pool = greedy.first_round(own, d.x, d.y, d.n, config)
    second = greedy.second_round(pool, 2, d.x, d.y, d.n, config)
    value = [greedy.set_objective(s.frame(spark).select("rule_id", "head", "tail").dropDuplicates(["rule_id"]), d.x, d.y, d.n, 1.0) for s in (first, second)]
    kept = greedy.fit(d.x, d.y, d.vocab_x, d.vocab_y, d.n, config)
    assert [s["rule_id"] for s in kept.steps] == [s["rule_id"] for s in (first if value[0] > value[1] else second).steps]
    assert len({s["rule_id"] for s in greedy.second_round(pool, 3, d.x, d.y, d.n, config, distinct=True).steps}) == 3
    with pytest.raises(greedy.InsufficientCandidates):
        greedy.second_round(None, 1, d.x, d.y, d.n, config)
    open_end = greedy.configured("v1", n_tails=20, n_heads=4, min_feature_proba=0.5, min_label_proba=0.9, tolerance=0.2)
    steps = greedy.first_round(own, d.x, d.y, d.n, open_end)[0].steps
    assert 0 < len(steps) < 10 and all(s["mc"] > 0.2 * d.y.count() for s in steps)


def test_exports(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert experiment.to_markdown(table.orderBy("n")) == "| n | s |\n| --- | --- |\n| 1 | a |\n| 2 | None |\n"
    for kind in ("csv", "json", "parquet"):
        experiment.export(table, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        experiment.export(table, str(tmp_path / "x"), "xls")
    with pytest.raises(ValueError):
        experiment.to_markdown(spark.range(experiment.MOST_ROWS + 1))


def test_sizes_are_checked_before_sending_or_pairing(spark, monkeypatch):
    from ruleloom.streaming import scoring

    rows = spark.createDataFrame([(0, [1]), (1, [2])], "rid long, items array<int>")
    monkeypatch.setattr(sets, "MOST_PAIRS", 3)
    monkeypatch.setattr(sampling, "MOST_PAIRS", 0)
    monkeypatch.setattr(scoring, "MOST_RULES", 0)
    for call in (lambda: sets.containment_loop(rows, rows.withColumnRenamed("rid", "sid")), lambda: sampling.pair_distribution(rows, rows.where("rid = 0")),
                 lambda: scoring.predict_stream(rows, spark.createDataFrame([([1], [2])], "head array<int>, tail array<int>"))):
        with pytest.raises(ValueError):
            call()
