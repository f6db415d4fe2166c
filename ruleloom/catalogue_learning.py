"""More registered queries: learning rule sets, greedy heads, draws, coverage updates, densities and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.catalogue import (
    DOCS, FILLED, FIRST, HEADS, LINES, ORACLES, QUERIES, SPACE, SUPP, TOP, U32, UNC, _covered, _orders, _rounded, _space, _top, query)
from ruleloom.functions.scalar import items_text
from ruleloom.operators import bicluster, evaluation, graph, rules, sampling, sets
from ruleloom.plans import experiment, greedy
from ruleloom.sources import relations
from ruleloom.sources.relations import docs

#: Feature sets with edges of at least 0.95 and the rows that contain them, as SPACE has it for labels.
X_LEAST = 0.95
X_GRAPH = """
fx AS (SELECT item, count(*) AS freq FROM x GROUP BY 1),
dirx AS MATERIALIZED (SELECT a.item AS u, b.item AS v, count(*) AS c, count(*) / any_value(freq) AS proba
  FROM x a JOIN x b USING (rid) JOIN fx ON fx.item = a.item WHERE a.item <> b.item GROUP BY 1, 2)"""
X_SPACE = X_GRAPH + """,
undx AS MATERIALIZED (SELECT * FROM (SELECT a.u, a.v, 1 - (1 - a.proba) * (1 - b.proba) AS proba FROM dirx a JOIN dirx b ON a.u = b.v AND a.v = b.u WHERE a.u < a.v) WHERE proba >= 0.95),
clqx(items, last, proba) AS (SELECT [item], item, CAST(1 AS DOUBLE) FROM vocab UNION ALL
  SELECT list_append(items, v), v, proba * f FROM (SELECT c.items, c.proba, e.v,
    (SELECT coalesce(product(w.proba), 0) * CAST(count(*) = len(c.items) AS INT) FROM undx w WHERE w.v = e.v AND list_contains(c.items, w.u)) AS f
    FROM clqx c JOIN undx e ON e.u = c.last) WHERE proba * f >= 0.95),
xspace AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY items) - 1 AS INT) AS sid, items, len(items) AS len FROM clqx),
exx AS (SELECT sid, len, unnest(items) AS item FROM xspace),
xassign AS MATERIALIZED (SELECT rid, sid FROM x JOIN exx USING (item) GROUP BY rid, sid, len HAVING count(*) = len),
xsupp AS MATERIALIZED (SELECT sid, count(*) AS supp FROM xassign GROUP BY 1),
ysupp AS MATERIALIZED (SELECT sid, count(*) AS n_pos FROM assign GROUP BY 1)"""

#: Parameters of the learning queries by version: tails, heads for each, weight of the last term, objective.
LEARNERS = {
    "v1": (20, 3, 0.1, "mc * kl + 0.1::DOUBLE * div"),
    "v2": (10, 1, 10.0, "mc * kl + 10 * div"),
    "v3": (10, 1, 1.0, "sqrt(mc) * kl + div"),
    "submod": (20, 3, 0.01, "CASE WHEN mc > 0 THEN kl ELSE 0 END + 0.01::DOUBLE * mc"),
}
RULES, SEED = 3, 12345


def _chosen_sql(name: str, found: str, before: str, objective: str) -> str:
    """``o<name>``: candidates ``found(tail, sid)`` with their objective after the choices ``before(step, rid, item)``."""
    return f"""
st{name} AS MATERIALIZED (SELECT tail, sid, p, q, CASE WHEN p <= q THEN 0 ELSE p * ln(p / q) + CASE WHEN p >= 1 THEN 0 ELSE (1 - p) * ln((1 - p) / (1 - q)) END END AS kl
  FROM (SELECT c.tail, c.sid, count(a.rid) / any_value(supp) AS p, any_value(n_pos) / any_value(n) AS q
    FROM {found} c JOIN xassign b ON b.sid = c.sid LEFT JOIN assign a ON a.sid = c.tail AND a.rid = b.rid JOIN xsupp s ON s.sid = c.sid JOIN ysupp t ON t.sid = c.tail, n GROUP BY 1, 2)),
rc{name} AS MATERIALIZED (SELECT c.tail, c.sid, a.rid, e.item FROM {found} c JOIN assign a ON a.sid = c.tail JOIN xassign b ON b.sid = c.sid AND b.rid = a.rid JOIN ex e ON e.sid = c.tail),
ar{name} AS (SELECT tail, sid, count(*) AS a FROM rc{name} GROUP BY 1, 2),
mc{name} AS (SELECT tail, sid, count(*) AS mc FROM rc{name} r ANTI JOIN (SELECT DISTINCT rid, item FROM {before}) c USING (rid, item) GROUP BY 1, 2),
al{name} AS (SELECT tail, sid, sum(i / (a + b - i)) AS s FROM (SELECT r.tail, r.sid, k.step, count(*) AS i FROM rc{name} r JOIN {before} k USING (rid, item) GROUP BY 1, 2, 3)
  JOIN (SELECT step, count(*) AS b FROM {before} GROUP BY 1) USING (step) JOIN ar{name} USING (tail, sid) GROUP BY 1, 2),
o{name} AS (SELECT tail, sid, mc, round({objective}, 9) AS objective FROM (SELECT tail, sid, kl, coalesce(mc, 0) AS mc,
  (SELECT count(DISTINCT step) FROM {before}) - coalesce(s, 0) AS div FROM st{name} LEFT JOIN mc{name} USING (tail, sid) LEFT JOIN al{name} USING (tail, sid)))"""


def _best_sql(name: str, round_: int, step: int, before: str) -> str:
    """``b<name>``: the best row of ``o<name>``; ``ch<name>``: the choices with its cells."""
    return f"""
b{name} AS MATERIALIZED (SELECT {round_} AS round, {step} AS step, tail, sid, xs.items AS head, ys.items AS labels, objective, mc
  FROM o{name} JOIN xspace xs USING (sid) JOIN space ys ON ys.sid = tail ORDER BY objective DESC, labels, head LIMIT 1),
ch{name} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT {step}, rid, item FROM rc{name} JOIN b{name} USING (tail, sid))"""


def _learn_sql(version: str) -> str:
    """Rounds of candidates drawn by hashes and the best of each, written out; for v1 also the choice from all of them."""
    n_tails, n_heads, _, objective = LEARNERS[version]
    parts = [SPACE, X_SPACE, "ch0 AS MATERIALIZED (SELECT 0 AS step, rid, item FROM y WHERE false)"]
    for k in range(RULES):
        before = f"ch{k}"
        tail_u = U32.format(f"'{SEED + k}|' || i")
        head_u = U32.format(f"'{SEED + k}|' || draw || '|' || tail || '|' || sid")
        parts.append(f"""
tw{k} AS MATERIALIZED (SELECT sid, count(u.rid) AS w FROM space LEFT JOIN (SELECT a.sid, a.rid, e.item FROM assign a JOIN ex e USING (sid)
  ANTI JOIN (SELECT DISTINCT rid, item FROM {before}) c USING (rid, item)) u USING (sid) GROUP BY sid),
tp{k} AS MATERIALIZED (SELECT sid, proba, sum(proba) OVER (ORDER BY sid) AS hi FROM (SELECT sid, w / sum(w) OVER () AS proba FROM tw{k}) WHERE proba > 0),
td{k} AS MATERIALIZED (SELECT DISTINCT sid AS tail FROM (SELECT {tail_u} AS u FROM range({n_tails}) t(i)) JOIN tp{k} ON u >= hi - proba AND u < hi),
hw{k} AS MATERIALIZED (SELECT tail, sid, CAST(plus * (n - n_pos - (supp - plus)) AS DOUBLE) AS w
  FROM (SELECT tail, b.sid, count(*) AS plus FROM td{k} JOIN assign a ON a.sid = tail JOIN xassign b ON b.rid = a.rid GROUP BY 1, 2)
  JOIN xsupp USING (sid) JOIN ysupp t ON t.sid = tail, n WHERE n_pos < n),
hd{k} AS MATERIALIZED (SELECT DISTINCT tail, sid FROM (SELECT tail, draw, arg_max(sid, ln(w) - ln(-ln({head_u}))) AS sid
  FROM hw{k}, (SELECT CAST(d AS INT) AS draw FROM range({n_heads}) t(d)) WHERE w > 0 GROUP BY 1, 2))""")
        parts += [_chosen_sql(str(k), f"hd{k}", before, objective), _best_sql(str(k), 1, k, before).replace(f"ch{k} AS", f"ch{k + 1} AS")]
    results = [f"SELECT * FROM b{k}" for k in range(RULES)]
    if version == "v1":
        pool = " UNION ".join(f"SELECT * FROM hd{k}" for k in range(RULES))
        parts += [f"pool AS MATERIALIZED ({pool})", "chp AS MATERIALIZED (SELECT 0 AS step, rid, item FROM y WHERE false)"]
        before = "chp"
        for k in range(RULES):
            parts += [_chosen_sql(f"p{k}", "pool", before, objective), _best_sql(f"p{k}", 2, k, before)]
            before = f"chp{k}"
        results += [f"SELECT * FROM bp{k}" for k in range(RULES)]
    return ("WITH RECURSIVE " + ",\n".join(parts).strip()
            + " SELECT CAST(round AS INT) AS round, CAST(step AS INT) AS step, array_to_string(head, ',') AS head, array_to_string(labels, ',') AS tail, round(objective, 6) AS objective, mc FROM ("
            + " UNION ALL ".join(results) + ")")


def _learn(version: str):
    n_tails, n_heads, lambd, _ = LEARNERS[version]

    def run(spark, sf_dir):
        """Rules learned from all documents: the first round's, and for v1 the second round's."""
        d = docs(spark, sf_dir)
        config = greedy.Config(version=version, lambd=lambd, n_tails=n_tails, n_heads=n_heads, n_max_rules=RULES, min_feature_proba=X_LEAST, min_label_proba=0.3, seed=SEED)
        own = greedy.spaces(d.x, d.y, d.vocab_x, d.vocab_y, config)
        chosen, pool = greedy.first_round(own, d.x, d.y, d.n, config)
        sides = [chosen] + ([greedy.second_round(pool, len(chosen.steps), d.x, d.y, d.n, config)] if version == "v1" else [])
        frames = [s.frame(spark).withColumn("round", F.lit(k + 1)) for k, s in enumerate(sides)]
        out = frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0]
        return out.select("round", "step", items_text("head").alias("head"), items_text("tail").alias("tail"), F.round("objective", 6).alias("objective"), "mc")

    return run


for _version in LEARNERS:
    QUERIES[f"learn_{_version}"] = _learn(_version)
    ORACLES[f"learn_{_version}"] = _learn_sql(_version)


#: Steps of a greedy head at most: one per feature.
HEAD_STEPS = 60


def _head_sql(universe: str, relative: bool) -> str:
    gain = "(CAST(sum(y) AS DOUBLE) - 0.5::DOUBLE * (count(*) - sum(y)))" + (" / any_value(f)" if relative else "")
    parts = [DOCS, f"""
tgt AS (SELECT rid FROM y WHERE item = 0), np AS (SELECT count(*) AS np FROM tgt), u AS ({universe}),
c0 AS MATERIALIZED (SELECT rid, item, CAST(rid IN (SELECT rid FROM tgt) AS INT) AS y FROM x WHERE item IN (SELECT item FROM u)),
fr AS MATERIALIZED (SELECT item, count(*) AS f FROM c0 GROUP BY 1)"""]
    for k in range(1, HEAD_STEPS + 1):
        stop = "" if k == 1 else " WHERE n >= 0.1::DOUBLE * (SELECT np FROM np)"
        parts.append(f"""
b{k} AS MATERIALIZED (SELECT * FROM (SELECT {k} AS place, item, count(*) AS n, round({gain}, 9) AS gain FROM c{k - 1} JOIN fr USING (item) GROUP BY item ORDER BY gain DESC, item LIMIT 1){stop}),
c{k} AS MATERIALIZED (SELECT * FROM c{k - 1} WHERE rid IN (SELECT c.rid FROM c{k - 1} c JOIN b{k} USING (item)) AND item NOT IN (SELECT item FROM b{k}))""")
    parts.append("steps AS (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, HEAD_STEPS + 1)) + ")")
    return "WITH " + ",".join(parts).strip() + " SELECT CAST(place - 1 AS INT) AS place, item FROM steps WHERE place <= (SELECT min(place) FROM steps WHERE gain = (SELECT max(gain) FROM steps))"


def _placed(spark, items: list[int]):
    return spark.createDataFrame(list(enumerate(items)), "place int, item int")


def prune_greedy_head(spark, sf_dir):
    """Greedy head of label 0 from every item of a positive row, by plain gains."""
    d = docs(spark, sf_dir)
    return _placed(spark, sampling.greedy_head(d.x, d.y.where("item = 0").select("rid"), relative=False))


def pair_greedy_head(spark, sf_dir):
    """Greedy head of label 0 from the items that the first positive row has and the first negative row lacks, by gains over frequency."""
    d = docs(spark, sf_dir)
    target = d.y.where("item = 0").select("rid")
    pos = d.x.join(target, "rid", "left_semi").agg(F.min("rid").alias("rid"))
    neg = d.x.join(target, "rid", "left_anti").agg(F.min("rid").alias("rid"))
    universe = d.x.join(pos, "rid", "left_semi").select("item").join(d.x.join(neg, "rid", "left_semi").select("item"), "item", "left_anti")
    return _placed(spark, sampling.greedy_head(d.x, target, universe))


QUERIES |= {"prune_greedy_head": prune_greedy_head, "pair_greedy_head": pair_greedy_head}
ORACLES["prune_greedy_head"] = _head_sql("SELECT DISTINCT item FROM x WHERE rid IN (SELECT rid FROM tgt)", False)
ORACLES["pair_greedy_head"] = _head_sql(
    "SELECT item FROM x WHERE rid = (SELECT min(rid) FROM x WHERE rid IN (SELECT rid FROM tgt)) EXCEPT "
    "SELECT item FROM x WHERE rid = (SELECT min(rid) FROM x WHERE rid NOT IN (SELECT rid FROM tgt))", True)


def _row_draw_sql(log_weight: str, draws: int, seed: int) -> str:
    """``dr(draw, rid, items)``: rows of ``s(rid, items)`` drawn by weight, a hash bucket first."""
    return f"""
lw AS (SELECT rid, items, {log_weight} AS lw FROM s WHERE len(items) > 0),
ww AS MATERIALIZED (SELECT rid, items, exp(lw - (SELECT max(lw) FROM lw)) AS w, CAST('0x' || substr(md5(CAST(rid AS VARCHAR)), 1, 8) AS UBIGINT) % 1024 AS bucket FROM lw),
tt AS (SELECT bucket, sum(w) AS total FROM ww GROUP BY 1),
bb AS (SELECT bucket, total, proba, sum(proba) OVER (ORDER BY bucket) AS hi FROM (SELECT *, total / sum(total) OVER () AS proba FROM tt)),
pk AS (SELECT i AS draw, bucket, total * {U32.format(f"'{seed}|row|' || i")} AS spot FROM range({draws}) t(i) JOIN bb ON {U32.format(f"'{seed}|' || i")} >= hi - proba AND {U32.format(f"'{seed}|' || i")} < hi),
sp AS (SELECT *, sum(w) OVER (PARTITION BY bucket ORDER BY rid) AS hi FROM ww),
dr AS MATERIALIZED (SELECT draw, rid, list_sort(items) AS items FROM pk JOIN sp USING (bucket) WHERE spot >= hi - w AND spot < hi)"""


@query(LINES + "," + _row_draw_sql("len(items) * ln(2) + ln(1 - pow(2, -len(items)))", 500, 21) + ", f AS (SELECT *, "
       + FIRST.format(u=U32.format("'21|' || draw || '|first'"), own="items") + " AS first FROM dr) SELECT draw, array_to_string("
       + FILLED.format(own="items", first="first", u=U32.format("'21|' || draw || '|' || i")) + ", ',') AS items FROM f")
def draw_patterns_by_support(spark, sf_dir):
    return sampling.draw_row_patterns(_orders(spark, sf_dir), 500, 21).select("draw", items_text().alias("items"))


@query(LINES + "," + _row_draw_sql("ln(len(items)) + (len(items) - 1) * ln(2)", 500, 22)
       + ", f AS (SELECT *, items[CAST(floor(" + U32.format("'22|' || draw || '|sure'") + " * len(items)) + 1 AS INT)] AS sure FROM dr) "
       + "SELECT draw, array_to_string(list_filter(items, lambda i: i = sure OR " + U32.format("'22|' || draw || '|' || i") + " < 0.5), ',') AS items FROM f")
def draw_patterns_by_area(spark, sf_dir):
    return sampling.draw_row_patterns(_orders(spark, sf_dir), 500, 22, area=True).select("draw", items_text().alias("items"))


def _grown_sql(steps: int) -> str:
    """Greedy tails inside drawn rows; no row has more than ``steps`` + 1 labels."""
    parts = [DOCS, "s AS (SELECT rid, list(item) AS items FROM y GROUP BY 1), tog AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM y a JOIN y b USING (rid) GROUP BY 1, 2)",
             _row_draw_sql("ln(len(items)) + (len(items) - 1) * ln(2)", 200, 11), f"""
l0 AS MATERIALIZED (SELECT draw, rid, items, least(len(items), 1 + len([i FOR i IN range(1, len(items) + 1) IF i * (i - 1) / 2 <= {U32.format("'11|size|' || draw")} * (len(items) * (len(items) - 1) / 2)])) AS k,
  [items[CAST(floor({U32.format("'11|first|' || draw")} * len(items)) + 1 AS INT)]] AS chosen FROM dr)"""]
    for k in range(1, steps + 1):
        parts.append(f"""
m{k} AS (SELECT draw, p.a, min(coalesce(n, 0)) AS m FROM (SELECT draw, a, unnest(chosen) AS b FROM (SELECT draw, chosen, unnest(list_filter(items, lambda i: NOT list_contains(chosen, i))) AS a
  FROM l{k - 1} WHERE len(chosen) < k)) p LEFT JOIN tog ON tog.a = p.a AND tog.b = p.b GROUP BY 1, 2),
n{k} AS (SELECT draw, arg_max(a, m * 1000 - a) AS a FROM m{k} GROUP BY 1),
l{k} AS MATERIALIZED (SELECT draw, rid, items, k, CASE WHEN a IS NULL THEN chosen ELSE list_append(chosen, a) END AS chosen FROM l{k - 1} LEFT JOIN n{k} USING (draw))""")
    return "WITH " + ",".join(parts).strip() + f" SELECT draw, rid, array_to_string(list_sort(chosen), ',') AS items FROM l{steps}"


def greedy_tail_draw(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sampling.greedy_tails(sets.rows_as_sets(d.y), graph.cooccurrence(d.y, d.y), 200, 11).select("draw", "rid", items_text().alias("items"))


QUERIES["greedy_tail_draw"], ORACLES["greedy_tail_draw"] = greedy_tail_draw, _grown_sql(4)


def random_cliques(spark, sf_dir):
    d = docs(spark, sf_dir)
    edges = graph.confidence_graph(d.x)
    return graph.walk_cliques(edges, d.vocab_x.select(F.col("item").alias("id"))).select("start", items_text().alias("items"))


QUERIES["random_cliques"] = random_cliques
ORACLES["random_cliques"] = "WITH RECURSIVE " + (DOCS + "," + X_GRAPH).strip() + f""",
walk(start, items, u, step) AS (SELECT item, [item], item, 0 FROM vocab UNION ALL
  SELECT start, list_append(items, v), v, step + 1 FROM (SELECT w.start, w.items, w.step,
    (SELECT arg_max(e.v, ln(e.proba) - ln(-ln({U32.format("'0|c|' || w.start || '|' || w.step || '|' || e.v")}))) FROM dirx e
     WHERE e.u = w.u AND NOT list_contains(w.items, e.v) AND {U32.format("'0|' || w.start || '|' || w.step || '|' || e.v")} < e.proba) AS v FROM walk w) g
  WHERE v IS NOT NULL AND (SELECT count(*) FROM dirx d WHERE d.v = g.v AND list_contains(g.items, d.u)) = len(g.items))
SELECT start, array_to_string(list_sort(arg_max(items, step)), ',') AS items FROM walk GROUP BY start"""


@query(SPACE + """, cov AS (SELECT rid, 0 AS item FROM y WHERE item = 0 UNION SELECT doc_id, i FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 3 = 0),
c AS (SELECT rid, item, count(*) AS cnt FROM assign JOIN ex USING (sid) ANTI JOIN cov USING (rid, item) GROUP BY 1, 2),
a AS (SELECT doc_id AS rid, coalesce(sum(cnt), 0) AS w FROM documents LEFT JOIN c ON rid = doc_id GROUP BY 1)
SELECT rid, CAST(w AS DOUBLE) AS w, round(w / sum(w) OVER (), 6) AS proba FROM a""")
def incremental_update(spark, sf_dir):
    """Row weights after three updates, of which the second repeats the first."""
    d, space, assign = _space(spark, sf_dir)
    counters = sampling.element_counters(assign, space, d.y.limit(0))
    once = _covered(d).select("rid")
    for rows, items in ((once, [0]), (once, [0]), (d.rows.where("rid % 3 = 0"), [0, 1])):
        counters = sampling.counters_after(counters, rows, items)
    return _rounded(sampling.counter_weights(counters, d.rows), "rid")


@query(SPACE + """, c AS (SELECT rid, count(*) AS w, count(*) FILTER (item IN (0, 1) AND rid IN (SELECT rid FROM y WHERE item = 0)) AS off FROM assign JOIN ex USING (sid) GROUP BY 1)
SELECT doc_id AS rid, CAST(coalesce(w - off, 0) AS DOUBLE) AS w FROM documents LEFT JOIN c ON rid = doc_id""")
def naive_update(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    weights = sampling.row_weights(assign, space, d.y.limit(0), d.rows)
    return sampling.weights_after_naive(weights, assign, space, _covered(d).select("rid"), [0, 1])


@query(UNC + ", w AS (SELECT rid, sid, count(*) AS w FROM unc GROUP BY 1, 2) SELECT rid AS draw, rid, arg_max(sid, ln(w) - ln(-ln(" + U32.format("'8|' || rid || '|' || rid || '|' || sid") + "))) AS sid FROM w GROUP BY rid")
def in_row_draw(spark, sf_dir):
    """A set from every row that has an uncovered item, in proportion to the items of it that are uncovered."""
    d, space, assign = _space(spark, sf_dir)
    rows = sampling.uncovered(assign, space, _covered(d)).select(F.col("rid").alias("draw"), "rid").distinct()
    return sampling.sets_in_rows(rows, assign, space, _covered(d), 8)


@query(SPACE + """, sx AS (SELECT item AS sid, count(*) AS supp FROM x GROUP BY 1), py AS (SELECT sid AS tail, count(*) AS n_pos FROM assign GROUP BY 1),
plus AS (SELECT a.sid AS tail, x.item AS sid, count(*) AS plus FROM x JOIN assign a USING (rid) GROUP BY 1, 2),
w AS (SELECT tail, sid, CAST(plus * (n - n_pos - (supp - plus)) AS DOUBLE) AS w FROM plus JOIN sx USING (sid) JOIN py USING (tail), n WHERE n_pos < n)
SELECT tail, sid, w, round(w / sum(w) OVER (PARTITION BY tail), 6) AS proba FROM w WHERE w > 0""")
def head_distribution_of_sets(spark, sf_dir):
    """Head weights for every label set of the sample space, not single labels only."""
    d, _, assign = _space(spark, sf_dir)
    return _rounded(sampling.head_distribution(d.x.withColumnRenamed("item", "sid"), assign.withColumnRenamed("sid", "item"), d.n), "tail", "sid")


@query(SPACE + " SELECT rid, sid FROM assign")
def containment_join_prefix(spark, sf_dir):
    d, space, _ = _space(spark, sf_dir)
    return sets.containment_prefix(d.y, space)


@query(DOCS + """, t AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM y a JOIN y b USING (rid) WHERE a.item <> b.item GROUP BY 1, 2)
SELECT a, string_agg(CAST(b AS VARCHAR), ',' ORDER BY n, b) AS items, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n, b) AS counts FROM t GROUP BY 1""")
def cooccurrence_lists(spark, sf_dir):
    y = docs(spark, sf_dir).y
    joined = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return graph.neighbour_lists(graph.cooccurrence(y, y)).select("a", joined("items"), joined("counts"))


@query("SELECT CAST(row_number() OVER (ORDER BY u, doc_id) - 1 AS INT) AS place, doc_id FROM (SELECT doc_id, " + U32.format("'17|' || doc_id") + " AS u FROM documents ORDER BY u, doc_id LIMIT 25)")
def first_of_permutation(spark, sf_dir):
    return sets.first_of_permutation(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", 25, 17)


def _uniform_sql(vocab: str, seed: int) -> str:
    return f"""{DOCS}, c AS (SELECT item, proba, sum(proba) OVER (ORDER BY item) AS hi FROM (SELECT item, 1 / count(*) OVER () AS proba FROM {vocab}))
SELECT draw, item FROM (SELECT i AS draw, {U32.format(f"'{seed}|' || i")} AS u FROM range(300) t(i)) JOIN c ON u >= hi - proba AND u < hi"""


@query(_uniform_sql("vocab_y", 31))
def uniform_labels(spark, sf_dir):
    return sampling.uniform_items(docs(spark, sf_dir).vocab_y, 300, 31)


@query(_uniform_sql("vocab", 32))
def uniform_features(spark, sf_dir):
    return sampling.uniform_items(docs(spark, sf_dir).vocab_x, 300, 32)


@query("SELECT event_type, round(avg(ln(value)), 6) AS mean_log FROM events WHERE value > 0 GROUP BY 1")
def log_means(spark, sf_dir):
    return evaluation.mean_log(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value").select("event_type", F.round("mean_log", 6).alias("mean_log"))


@query(DOCS + " SELECT DISTINCT item FROM x WHERE rid IN (SELECT rid FROM y WHERE item = 0)")
def positive_items(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sets.items_of(d.x, d.y.where("item = 0"))


@query(DOCS + " SELECT item AS old, CAST(row_number() OVER (ORDER BY item) - 1 AS INT) AS new FROM (SELECT DISTINCT item FROM x WHERE rid IN (SELECT rid FROM y WHERE item = 0))")
def compact_items(spark, sf_dir):
    return sets.compact(positive_items(spark, sf_dir))


@query(TOP + """ SELECT rule_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(kl * support, 6) AS quality FROM top JOIN stats USING (h, t)""")
def rule_evaluation(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = rules.validated(_top(spark, sf_dir, 20), d.x, d.vocab_x, d.vocab_y)
    return rules.evaluation_batch(found, d.x, d.y, d.n).select("rule_id", F.round("f1", 6).alias("f1"), F.round("quality", 6).alias("quality"))


DENSITY = DOCS + """,
g AS (SELECT p / 20 AS p, q / 20 AS q FROM range(1, 20) a(p), range(1, 20) b(q) WHERE p > q),
o AS (SELECT v.item, count(x.rid) AS ones FROM vocab v LEFT JOIN x USING (item) GROUP BY 1),
m AS (SELECT p, q, ones, n, ones > round(ln((1 - q) / (1 - p)) / ln(p * (1 - q) / (q * (1 - p))) * n, 6) AS own FROM g, o, n),
e AS (SELECT p, q, coalesce(sum(ones) FILTER (own) / (count(*) FILTER (own) * any_value(n)), 1) AS inside,
  coalesce(sum(ones) FILTER (NOT own) / (count(*) FILTER (NOT own) * any_value(n)), 0) AS outside, count(*) FILTER (own) AS size FROM m GROUP BY 1, 2),
d AS (SELECT *, abs(p - inside) + abs(q - outside) AS gap FROM e)"""


def _densities(spark, sf_dir):
    d = docs(spark, sf_dir)
    return bicluster.density_estimate(d.x, d.vocab_x, d.n, 20)


def _shown(found):
    return found.select(*(F.round(c, 6).alias(c) for c in ("p", "q", "inside", "outside", "gap")), "size")


@query(DENSITY + " SELECT round(p, 6) AS p, round(q, 6) AS q, round(inside, 6) AS inside, round(outside, 6) AS outside, round(gap, 6) AS gap, size FROM d")
def density_grid(spark, sf_dir):
    return _shown(_densities(spark, sf_dir))


@query(DENSITY + " SELECT round(p, 6) AS p, round(q, 6) AS q, round(inside, 6) AS inside, round(outside, 6) AS outside, round(gap, 6) AS gap, size FROM d ORDER BY round(d.gap, 9), d.p, d.q LIMIT 1")
def best_densities(spark, sf_dir):
    return _shown(bicluster.best_densities(_densities(spark, sf_dir)))


@query(f"""r AS (SELECT i AS rid FROM range(400) t(i)), f AS (SELECT CAST(i AS INT) AS item FROM range(8) t(i)), l AS (SELECT CAST(i AS INT) AS label FROM range(5) t(i)),
y AS (SELECT rid, label FROM r, l WHERE {U32.format("'6|y|' || rid || '|' || label")} < 0.4::DOUBLE),
a AS (SELECT rid, item, sum(floor({U32.format("'6|a|' || label || '|' || item")} * 10)) AS s FROM y, f GROUP BY 1, 2),
v AS (SELECT r.rid, f.item, CAST(coalesce(s, 0) + floor({U32.format("'6|x|' || r.rid || '|' || f.item")} * 10) AS DOUBLE) AS v FROM r CROSS JOIN f LEFT JOIN a ON a.rid = r.rid AND a.item = f.item),
c AS (SELECT item, quantile_cont(v, 0.7) AS cut FROM v GROUP BY 1)
SELECT 'feature' AS kind, rid, item FROM v JOIN c USING (item) WHERE v > cut UNION ALL SELECT 'label', rid, label FROM y""")
def random_multilabel(spark, sf_dir):
    x, y = relations.random_multilabel(spark, 400, 8, 5, 2.0, 0.3, 6)
    return x.select(F.lit("feature").alias("kind"), "rid", "item").unionByName(y.select(F.lit("label").alias("kind"), "rid", "item"))


def _draws_sql(name: str, weights: str) -> str:
    return f"""{name}_c AS (SELECT sid, proba, sum(proba) OVER (ORDER BY sid) AS hi FROM (SELECT sid, w / sum(w) OVER () AS proba FROM ({weights})) WHERE proba > 0),
{name}_d AS (SELECT '{name}' AS sampler, sid FROM (SELECT {U32.format("'13|' || i")} AS u FROM range(400) t(i)) JOIN {name}_c ON u >= hi - proba AND u < hi)"""


@query(SUPP + "," + _draws_sql("area", "SELECT sid, supp * len AS w FROM supp") + "," + _draws_sql("frequency", "SELECT sid, supp AS w FROM supp") + "," + _draws_sql("uniform", "SELECT sid, 1 AS w FROM supp")
       + " SELECT sampler, count(*) AS draws, round(avg(supp), 6) AS support_size, round(avg(supp * len), 6) AS area, round(avg(len), 6) AS length"
       + " FROM (SELECT * FROM area_d UNION ALL SELECT * FROM frequency_d UNION ALL SELECT * FROM uniform_d) JOIN supp USING (sid) GROUP BY 1")
def tail_sampler_comparison(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = experiment.compare_tail_samplers(d.y, d.vocab_y, d.n, 0.3, 400, 13)
    means = (F.round(F.avg(c), 6).alias(c) for c in ("support_size", "area", "length"))
    return found.groupBy("sampler").agg(F.count("*").alias("draws"), *means)


@query(HEADS + " SELECT tail, sid, w FROM w WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY tail ORDER BY w DESC, sid) <= 3")
def best_heads(spark, sf_dir):
    """The three heaviest heads of each label."""
    from pyspark.sql import Window

    d = docs(spark, sf_dir)
    found = sampling.head_distribution(d.x.withColumnRenamed("item", "sid"), d.y, d.n)
    # a row per label and token
    place = F.row_number().over(Window.partitionBy("tail").orderBy(F.desc("w"), "sid"))
    return found.withColumn("place", place).where("place <= 3").select("tail", "sid", "w")
