"""Hand-computed values on tiny relations."""

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import evaluation, graph, rules, sampling, sets
from ruleloom.plans import greedy
from ruleloom.sources import relations


def cells(spark, matrix):
    return spark.createDataFrame([(r, i) for r, row in enumerate(matrix) for i in row], "rid long, item int")


def rule_table(spark, pairs):
    return spark.createDataFrame([(k, list(h), list(t)) for k, (h, t) in enumerate(pairs)], "rule_id long, head array<int>, tail array<int>")


def test_rule_statistics(spark):
    d = relations.toy(spark)
    table = rule_table(spark, [((0,), (0,)), ((2,), (1,)), ((0, 1), (0, 1))])
    got = {r["rule_id"]: r for r in rules.statistics(table, d.x, d.y, d.n).collect()}
    assert [got[k]["support"] for k in range(3)] == [2, 1, 1]
    assert got[0]["kl"] == pytest.approx(0.405465, abs=1e-6)
    assert got[1]["kl"] == 0 and got[1]["precision"] == 0.5
    assert got[2]["kl"] == pytest.approx(1.098612, abs=1e-6) and got[2]["area"] == 2


def test_distances(spark):
    d = relations.toy(spark)
    table = rule_table(spark, [((0,), (0,)), ((2,), (1,)), ((1,), (0,))])
    got = {(r["r1"], r["r2"]): r["distance"] for r in rules.distances(rules.rectangles(table, d.x, d.y), table).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5, (1, 2): 1.0}


def test_coverage(spark):
    d = relations.toy(spark)
    table = rule_table(spark, [((0,), (0,)), ((0, 1), (0,)), ((0, 1), (1,))])
    found = rules.rectangles(table, d.x, d.y)
    assert {r["rule_id"]: r["uncovered"] for r in rules.marginal_coverage(found, found.where("rule_id = 0")).collect()} == {0: 0, 1: 0, 2: 1}
    assert rules.coverage_ratio(found.where("rule_id = 0"), d.y).first()[0] == 0.5


def test_predict(spark):
    d = relations.toy(spark)
    got = greedy.predict(d.x, rule_table(spark, [((0,), (0,)), ((1,), (1,))])).collect()
    assert {(r["rid"], r["item"]) for r in got} == {(0, 0), (2, 0), (0, 1), (1, 1)}


def test_containment(spark):
    rows = cells(spark, [(2, 3, 7), (3, 7, 8, 9), (), (7,)])
    space = spark.createDataFrame([(0, [3, 7]), (1, [7]), (2, [8, 3]), (3, [2, 9]), (4, [11]), (5, [7, 3, 9]), (6, [3, 7, 11])], "sid int, items array<int>")
    want = {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 5), (3, 1)}
    assert {tuple(r) for r in sets.containment_division(rows, space).collect()} == want
    assert {tuple(r) for r in sets.containment_loop(sets.rows_as_sets(rows), space).collect()} == want
    assert {tuple(r) for r in sets.containment_prefix(rows, space).collect()} == want
    assert sets.containment_prefix(rows, space.limit(0)).count() == 0


def test_set_search(spark):
    space = spark.createDataFrame([(0, [2]), (1, [2, 6]), (2, [6, 2, 7]), (3, [7, 10]), (4, [3])], "sid int, items array<int>")
    ids = lambda df: sorted(r["sid"] for r in df.collect())
    assert ids(sets.search_supersets(space, [6, 2])) == [1, 2]
    assert ids(sets.search_subsets(space, [2, 6, 3])) == [0, 1, 4]
    assert ids(sets.search_exact(space, [7, 6, 2])) == [2] and ids(sets.search_exact(space, [])) == ids(sets.search_subsets(space, [])) == []
    with pytest.raises(ValueError):
        sets.search_supersets(space, [])


def test_cliques(spark):
    """A triangle of 0.8, 0.9 and 0.5 with a tail of 0.7: products by hand."""
    edges = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.9), (1, 2, 0.5), (2, 3, 0.7)], "u int, v int, proba double")
    nodes = spark.range(5).select(F.col("id").cast("int"))
    found = lambda least: {tuple(r["items"]): round(r["proba"], 9) for r in graph.probable_cliques(nodes, edges, least).collect()}
    single = {(i,): 1.0 for i in range(5)}
    assert found(0.95) == single and found(0.75) == single | {(0, 1): 0.8, (0, 2): 0.9}
    assert found(0.36) == single | {(0, 1): 0.8, (0, 2): 0.9, (1, 2): 0.5, (2, 3): 0.7, (0, 1, 2): 0.36}


def test_cliques_of_any_size(spark):
    n = 70
    edges = spark.createDataFrame([(u, u + 1, 1.0) for u in range(n - 1)] + [(u, v, 1.0) for u in range(4) for v in range(u + 2, 4)], "u int, v int, proba double")
    found = graph.probable_cliques(spark.range(n).select(F.col("id").cast("int")), edges, 0.9)
    assert found.agg(F.max("len")).first()[0] == 4 and found.count() == n + (n - 1 + 3) + 4 + 1


def test_connectivity(spark):
    edges = spark.createDataFrame([(0, 1, 0.2), (1, 0, 0.6), (0, 3, 1.0), (3, 0, 0.1)], "u int, v int, proba double")
    assert [(r["u"], r["v"], round(r["proba"], 9)) for r in graph.connectivity_graph(edges).orderBy("u", "v").collect()] == [(0, 1, 0.68), (0, 3, 1.0)]


def test_walks_end_in_cliques(spark):
    near = [(0, 1), (0, 2), (1, 2), (2, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for u, v in near for a, b in ((u, v), (v, u))], "u int, v int, proba double")
    got = {r["start"]: r["items"] for r in graph.walk_cliques(edges, spark.range(5).select(F.col("id").cast("int"))).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[4] == [4]
    for start, items in got.items():
        assert items[0] == start and all((min(a, b), max(a, b)) in near for i, a in enumerate(items) for b in items[:i])


def test_greedy_head(spark):
    x = cells(spark, [(0, 1), (0, 1), (0, 2), (2,), (1, 2)])
    assert sampling.greedy_head(x, spark.range(2).toDF("rid")) == [0, 1]


def test_uncovered_area(spark):
    space = spark.createDataFrame([(0, [0]), (1, [1]), (2, [0, 1])], "sid int, items array<int>")
    assign = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0)], "rid long, sid int")
    rows = spark.range(2).toDF("rid")
    w = lambda pairs: [r["w"] for r in sampling.row_weights(assign, space, spark.createDataFrame(pairs, "rid long, item int"), rows).orderBy("rid").collect()]
    assert w([(9, 9)]) == [4, 1] and w([(0, 0), (0, 1)]) == [0, 1] and w([(0, 1)]) == [2, 1]
    assert [r["proba"] for r in sampling.row_weights(assign, space, spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "rid long, item int"), rows).collect()] == [0.5, 0.5]


def test_discriminative_heads(spark):
    """Positives {a, b} and {b}, negatives {b, c}, {a} and {}: weights are positives with a set times negatives without it."""
    x = cells(spark, [(0, 1), (1,), (1, 2), (0,), ()])
    target = spark.range(2).toDF("rid")
    got = sampling.head_distribution(x.withColumnRenamed("item", "sid"), target.select("rid", F.lit(0).alias("item")), 5).collect()
    assert {r["sid"]: (r["w"], round(r["proba"], 6)) for r in got} == {0: (2, round(2 / 6, 6)), 1: (4, round(4 / 6, 6))}
    rows = sets.rows_as_sets(x).unionByName(spark.createDataFrame([(4, [])], "rid long, items array<int>"))
    full = sampling.powerset_heads(rows, target).collect()
    assert {tuple(r["items"]): r["w"] for r in full} == {(0,): 2, (1,): 4, (0, 1): 3}
    pairs = sampling.pair_distribution(rows, target, full=True).collect()
    assert {(r["pos"], r["neg"]): r["w"] for r in pairs} == {(0, 2): 2, (0, 3): 2, (0, 4): 3, (1, 3): 1, (1, 4): 1}


def test_chain_trace(spark):
    rows = [(c, *r) for c in (7, None) for r in ((0, 0, 2, 2.0, 2.0, 0.5), (1, 1, 2, 2.0, 2.0, 0.5), (2, 1, 3, 1.0, 4.0, 0.9))]
    steps = spark.createDataFrame(rows, "chain int, step int, pos int, neg int, w double, bound double, u double")
    got = sampling.chain_trace(steps).orderBy("chain", "step").collect()
    assert [(r["ratio"], r["accepted"]) for r in got] == [(1.0, True), (1.0, True), (0.25, False)] * 2
    long = spark.range(30_000).selectExpr("0 AS chain", "int(id) AS step", "1 AS pos", "2 AS neg", "1.0 + id % 3 AS w", "1.0 AS bound", "0.5 AS u")
    w, accepted = 1.0, 0
    for i in range(30_000):
        if 0.5 < (1 + i % 3) / w:
            w, accepted = 1.0 + i % 3, accepted + 1
    assert sampling.chain_trace(long).where("accepted").count() == accepted


def test_metrics_over_the_whole_vocabulary(spark):
    truth, pred = cells(spark, [(0,), (0, 1), ()]), cells(spark, [(0,), (1,), (1,)])
    vocab = spark.createDataFrame([(0,), (1,), (2,)], "item int")
    r = evaluation.report(pred, truth, vocab, 3).first()
    assert r["hamming_accuracy"] == pytest.approx(1 - 2 / 9) and r["subset_accuracy"] == pytest.approx(1 / 3)
    assert r["micro_f1"] == pytest.approx(2 / 3) and r["macro_precision"] == pytest.approx((1 + 0.5 + 1) / 3)


def test_tail_metrics(spark):
    y = cells(spark, [(0, 1, 2, 3), (0,), (0,), (0,)])
    space = spark.createDataFrame([(0, [0, 1, 2])], "sid int, items array<int>")
    r = evaluation.tail_report(space, sets.containment_division(y, space), graph.confidence_graph(y), 4).first()
    assert (r["support_size"], r["frequency"], r["area"], r["length"]) == (1, 0.25, 3, 3)
    assert r["edge_density"] == pytest.approx(4.5 / 3) and r["edge_ratio"] == pytest.approx(4.5 / 6)


def test_selection_and_persistence(spark, tmp_path):
    d = relations.toy(spark)
    table = rule_table(spark, [((0,), (0,)), ((1,), (1,)), ((2,), (1,))])
    config = greedy.Config(version="v1", n_max_rules=2, lambd=0.1)
    got = greedy.select(table, d.x, d.y, d.n, config, 2)
    assert [s["rule_id"] for s in got.steps] == [0, 1] and [s["mc"] for s in got.steps] == [2, 2]
    greedy.save(got, config, spark, str(tmp_path / "model"))
    again, same = greedy.load(spark, str(tmp_path / "model"))
    assert same == config and [s["head"] for s in again.steps] == [[0], [1]]


def test_fit_learns_planted_rules(spark):
    x, y = relations.synthetic_rules(spark, 60, [([0, 1], [0]), ([2, 3], [1])], seed=3)
    names = lambda n: spark.createDataFrame([(i, str(i)) for i in range(n)], "item int, name string")
    found = greedy.fit(x, y, names(4), names(2), 60, greedy.Config(version="v2", n_max_rules=2, n_tails=20, n_heads=4, min_feature_proba=0.5, min_label_proba=0.9, lambd=1.0))
    assert {tuple(s["tail"]) for s in found.steps} == {(0,), (1,)}


def test_arff(spark, tmp_path):
    from ruleloom.sources import arff

    sparse = tmp_path / "s.arff"
    sparse.write_text("@relation r\n@attribute a {0,1}\n@attribute b {0,1}\n@attribute l {0,1}\n\n@data\n{0 1,2 1}\n{1 1}\n{}\n")
    x, y, names = arff.read_sparse(spark, str(sparse), 1)
    assert [r["item"] for r in x.orderBy("rid").collect()] == [0, 1] and [r["item"] for r in y.collect()] == [0] and names == ["a", "b", "l"]
    dense = tmp_path / "d.arff"
    dense.write_text("@relation r\n@attribute a numeric\n@attribute c {u,v,w}\n@attribute l {0,1}\n@data\n-1,u,1\n2,v,0\n,w,1\n")
    x, y = arff.read_dense(spark, str(dense), 1)
    assert sorted(r["name"] for r in x.collect()) == ["a", "c=u", "c=v", "c=w"] and y.count() == 2


def test_streaming_scores(spark, tmp_path):
    from ruleloom.streaming.scoring import predict_stream

    path = str(tmp_path / "in")
    spark.createDataFrame([(0, [0, 1]), (1, [2])], "rid long, items array<int>").write.parquet(path)
    rows = spark.readStream.schema("rid long, items array<int>").parquet(path)
    q = predict_stream(rows, rule_table(spark, [((0,), (1,))])).writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from scores").collect()] == [(0, 1)]


def test_greedy_tails_grow_by_least_cooccurrence(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    own = {r: sorted(rng.sample(range(7), rng.randint(1, 6))) for r in range(40)}
    rows = spark.createDataFrame(list(own.items()), "rid long, items array<int>")
    pairs = Counter((a, b) for items in own.values() for a in items for b in items)
    together = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a int, b int, n long")
    got = sampling.greedy_tails(rows, together, 300, 2).collect()
    assert len(got) == 300 and all(set(r["items"]) <= set(own[r["rid"]]) for r in got)
    assert all(len(r["items"]) >= 2 for r in got if len(own[r["rid"]]) > 1)

    def grown(items, first, k):
        chosen = [first]
        while len(chosen) < k:
            chosen.append(max((i for i in items if i not in chosen), key=lambda i: (min(pairs[i, j] for j in chosen), -i)))
        return sorted(chosen)

    assert all(r["items"] in [grown(own[r["rid"]], f, len(r["items"])) for f in own[r["rid"]]] for r in got)
    expected = {r: len(i) * 2 ** (len(i) - 1) for r, i in own.items()}
    sizes = Counter(len(own[r["rid"]]) for r in got)
    for n in (5, 6):
        share = sum(w for r, w in expected.items() if len(own[r]) == n) / sum(expected.values())
        assert abs(sizes[n] / 300 - share) < 0.12


def test_rows_are_drawn_by_weight_from_any_bucket(spark):
    weights = spark.range(500).selectExpr("id AS rid", "double(CASE WHEN id < 5 THEN 99 WHEN id < 10 THEN 0 ELSE 1 END) AS w")
    got = [r["rid"] for r in sampling.draw_rows(weights, 4000, 3, "rid", buckets=16).collect()]
    assert len(got) == 4000 and not any(5 <= r < 10 for r in got)
    assert abs(sum(r < 5 for r in got) / 4000 - 495 / 985) < 0.04
    assert sampling.draw_rows(weights.limit(0), 5, 3, "rid").count() == 0


def test_pair_patterns_hold_an_item_of_the_first_only(spark):
    pairs = spark.range(200).selectExpr("id", "array(1, 2, 3) AS p", "array(2, 9) AS q")
    got = [set(r["pattern"]) for r in sampling.pair_patterns(pairs, 4, "id").collect()]
    assert all(s & {1, 3} and s <= {1, 2, 3} for s in got)
    assert len({frozenset(s) for s in got}) == 6


def best_prefix(own, target, items, gamma=0.5, epsilon=0.1, relative=True):
    """The greedy head in plain Python: over the rows' sets ``own``."""
    left = sorted(set(items))
    rows, chosen, gains = dict(own), [], []
    freq = {i: sum(i in s for s in own.values()) if relative else 1 for i in left}
    while left:
        score = {i: round((sum(i in s for r, s in rows.items() if r in target) - gamma * sum(i in s for r, s in rows.items() if r not in target)) / freq[i], 9) for i in left}
        item = max(left, key=lambda i: (score[i], -i))
        rows = {r: s for r, s in rows.items() if item in s}
        if chosen and len(rows) < epsilon * len(target) or not rows:
            break
        chosen.append(item)
        gains.append(score[item])
        left.remove(item)
    return chosen[: gains.index(max(gains)) + 1] if gains else []


@pytest.mark.parametrize("relative", [True, False])
def test_greedy_head_takes_every_item_of_a_positive_row(spark, relative):
    import random

    rng = random.Random(int(relative))
    own = {r: {i for i in range(40) if rng.random() < (0.9 if i in (27, 31) and r < 30 else 0.2)} for r in range(90)}
    target = set(range(30))
    x = spark.createDataFrame([(r, i) for r, s in own.items() for i in s], "rid long, item int")
    positive = {i for r in target for i in own[r]}
    rows = spark.range(30).toDF("rid")
    got = sampling.greedy_head(x, rows, relative=relative)
    assert got == best_prefix(own, target, positive, relative=relative) and set(got) & {27, 31}
    apart = {r: s for r, s in own.items() if r >= 30}
    assert sampling.greedy_head(x.where("rid >= 30"), rows, relative=relative) == best_prefix(apart, target, range(40), relative=relative)
    some = spark.createDataFrame([(3,), (4,), (31,)], "item int")
    assert sampling.greedy_head(x, rows, some, relative=relative) == best_prefix(own, target, [3, 4, 31], relative=relative)
