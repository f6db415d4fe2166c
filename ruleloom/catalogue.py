"""The registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.scalar import items_text, kl_bernoulli, uniform
from ruleloom.operators import bicluster, evaluation, graph, rules, sampling, sets
from ruleloom.plans import greedy
from ruleloom.sources import relations
from ruleloom.sources.relations import docs
from ruleloom.sources.scratch import release, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The documents as relations, in SQL: tok, vocab, x, names, vocab_y, y and n.
DOCS = """
tok AS (SELECT doc_id AS rid, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'))) AS token FROM documents),
vocab AS (SELECT token AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS INT) AS item FROM tok WHERE token <> '' GROUP BY token ORDER BY count(*) DESC, token LIMIT 60),
x AS (SELECT rid, item FROM tok JOIN vocab ON token = name),
names AS (SELECT doc_id AS rid, 'lang=' || lang AS name FROM documents WHERE lang IS NOT NULL UNION SELECT doc_id, 'quality=' || quality FROM labels WHERE quality IS NOT NULL UNION SELECT doc_id, 'toxic=' || toxic FROM labels WHERE toxic IS NOT NULL),
vocab_y AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS item FROM (SELECT DISTINCT name FROM names)),
y AS (SELECT DISTINCT rid, item FROM names JOIN vocab_y USING (name)),
n AS (SELECT count(*) AS n FROM documents)"""
#: Rules of one token and one label.
PAIRS = DOCS + """,
hs AS (SELECT item AS h, count(*) AS head_support FROM x GROUP BY 1),
ts AS (SELECT item AS t, count(*) AS tail_support FROM y GROUP BY 1),
counted AS (SELECT x.item AS h, y.item AS t, count(*) AS support FROM x JOIN y USING (rid) GROUP BY 1, 2),
shares AS (SELECT h, t, support, head_support, tail_support, support / head_support AS p, support / tail_support AS r, tail_support / n AS q FROM counted JOIN hs USING (h) JOIN ts USING (t), n),
stats AS (SELECT *, CASE WHEN p <= q THEN 0 ELSE p * ln(p / q) + CASE WHEN p >= 1 THEN 0 ELSE (1 - p) * ln((1 - p) / (1 - q)) END END AS kl FROM shares)"""
#: Confidence and connectivity graphs of the labels.
GRAPH = DOCS + """,
fy AS (SELECT item, count(*) AS freq FROM y GROUP BY 1),
dir AS (SELECT a.item AS u, b.item AS v, count(*) AS c, count(*) / any_value(freq) AS proba FROM y a JOIN y b USING (rid) JOIN fy ON fy.item = a.item WHERE a.item <> b.item GROUP BY 1, 2),
und AS (SELECT a.u, a.v, 1 - (1 - a.proba) * (1 - b.proba) AS proba FROM dir a JOIN dir b ON a.u = b.v AND a.v = b.u WHERE a.u < a.v)"""
#: Label sets with edges of at least one half, the rows that contain them, and the space's numbers.
SPACE = GRAPH + """,
clq(items, last, proba) AS (SELECT [item], item, CAST(1 AS DOUBLE) FROM vocab_y UNION ALL
  SELECT list_append(items, v), v, proba * f FROM (SELECT c.items, c.proba, e.v, (SELECT coalesce(product(w.proba), 0) * CAST(count(*) = len(c.items) AS INT) FROM und w WHERE w.v = e.v AND list_contains(c.items, w.u)) AS f FROM clq c JOIN und e ON e.u = c.last) WHERE proba * f >= 0.3),
space AS (SELECT CAST(row_number() OVER (ORDER BY items) - 1 AS INT) AS sid, items, len(items) AS len, proba FROM clq),
ex AS (SELECT sid, len, unnest(items) AS item FROM space),
assign AS (SELECT rid, sid FROM y JOIN ex USING (item) GROUP BY rid, sid, len HAVING count(*) = len)"""
LEAST = 0.3


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = ("WITH RECURSIVE " if "clq" in sql or "fold(" in sql else "WITH ") + sql.strip() if not sql.lstrip().startswith("SELECT") else sql.strip()
        return fn

    return add


_SPACES = relations.Kept(lambda kept: release(*kept[1:]))


def _space(spark: SparkSession, sf_dir: str):
    """The documents' relations with the labels' sample space and the rows that contain its sets; kept until the files change."""
    def make():
        d = docs(spark, sf_dir)
        space = stored(graph.sample_space(d.y, d.vocab_y, LEAST))
        return d, space, stored(sets.containment_division(d.y, space))

    return _SPACES.get(spark, [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")], (sf_dir,), make)


def _covered(d) -> DataFrame:
    """A fixed coverage state: label 0 of all its rows."""
    return d.y.where("item = 0")


def _pairs(spark: SparkSession, sf_dir: str, width: int | None = 60) -> DataFrame:
    d = docs(spark, sf_dir, width)
    return rules.pair_statistics(d.x, d.y, d.n)


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The best ``k`` single-item rules as a rule table, numbered by rank."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("score"), "h", "t")
    top = _pairs(spark, sf_dir).select("h", "t", F.round(F.col("kl") * F.col("area"), 6).alias("score")).orderBy(F.desc("score"), "h", "t").limit(k)
    return top.select((F.row_number().over(order) - 1).cast("long").alias("rule_id"), F.array("h").alias("head"), F.array("t").alias("tail"))


TOP = PAIRS + """,
top AS (SELECT row_number() OVER (ORDER BY score DESC, h, t) - 1 AS rule_id, h, t FROM (SELECT h, t, round(kl * support, 6) AS score FROM stats) ORDER BY score DESC, h, t LIMIT 20),
cells AS (SELECT rule_id, x.rid, y.item FROM top JOIN x ON x.item = h JOIN y ON y.rid = x.rid AND y.item = t)"""


@query(PAIRS + " SELECT v.name AS head, w.name AS tail, support, round(p, 6) AS precision, round(r, 6) AS recall, round(q, 6) AS base_rate, round(kl, 6) AS kl, support AS area FROM stats JOIN vocab v ON v.item = h JOIN vocab_y w ON w.item = t")
def rule_stats(spark, sf_dir, width=60):
    d = docs(spark, sf_dir, width)
    named = _pairs(spark, sf_dir, width).join(d.vocab_x.select(F.col("item").alias("h"), F.col("name").alias("head")), "h").join(d.vocab_y.select(F.col("item").alias("t"), F.col("name").alias("tail")), "t")
    return named.select("head", "tail", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "base_rate", "kl")), F.col("area").cast("long").alias("area"))


@query(PAIRS + " SELECT v.name AS head, w.name AS tail, support, round(kl * support, 6) AS score FROM stats JOIN vocab v ON v.item = h JOIN vocab_y w ON w.item = t ORDER BY score DESC, h, t LIMIT 20")
def rule_topk(spark, sf_dir, width=60):
    d = docs(spark, sf_dir, width)
    top = _pairs(spark, sf_dir, width).select("h", "t", "support", F.round(F.col("kl") * F.col("area"), 6).alias("score")).orderBy(F.desc("score"), "h", "t").limit(20)
    named = top.join(d.vocab_x.select(F.col("item").alias("h"), F.col("name").alias("head")), "h").join(d.vocab_y.select(F.col("item").alias("t"), F.col("name").alias("tail")), "t")
    return named.select("head", "tail", "support", "score")


@query(DOCS + " SELECT name, count(*) AS freq FROM x JOIN vocab USING (item) GROUP BY 1")
def item_frequency(spark, sf_dir, width=60):
    d = docs(spark, sf_dir, width)
    return sets.frequency(d.x).join(d.vocab_x, "item").select("name", "freq")


@query(DOCS + " SELECT name, count(*) AS freq FROM y JOIN vocab_y USING (item) GROUP BY 1")
def label_frequency(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sets.frequency(d.y).join(d.vocab_y, "item").select("name", "freq")


@query(DOCS + " SELECT item, rid // 1024 AS block, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS rids FROM y GROUP BY 1, 2")
def inverted_index(spark, sf_dir):
    return sets.inverted_index(docs(spark, sf_dir).y, 1024).select("item", "block", F.array_join(F.transform("rids", lambda r: r.cast("string")), ",").alias("rids"))


@query(DOCS + " SELECT rid, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, count(*) AS n FROM x GROUP BY 1")
def rows_as_sets(spark, sf_dir, width=60):
    return sets.rows_as_sets(docs(spark, sf_dir, width).x).select("rid", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query(DOCS + " SELECT rid, count(*) AS n FROM x WHERE rid IN (SELECT rid FROM y) GROUP BY 1")
def filter_rows_with_labels(spark, sf_dir, width=60):
    d = docs(spark, sf_dir, width)
    return sets.labelled_rows(d.x, d.y).groupBy("rid").agg(F.count("*").alias("n"))


@query(DOCS + " SELECT rid FROM x WHERE item IN (3, 5) GROUP BY 1 HAVING count(*) = 2")
def conjunctive_filter(spark, sf_dir):
    return sets.having_all(docs(spark, sf_dir).x, [3, 5])


@query(DOCS + " SELECT n AS n_rows, (SELECT count(*) FROM vocab) AS n_features, (SELECT count(*) FROM vocab_y) AS n_labels, (SELECT count(*) FROM x) AS nnz_x, (SELECT count(*) FROM y) AS nnz_y FROM n")
def dataset_shape(spark, sf_dir, width=60):
    return docs(spark, sf_dir, width).shape()


@query("SELECT rid, name FROM (SELECT p_partkey AS rid, unnest([{'name': 'p_size', 'one': p_size > (SELECT quantile_cont(p_size, 0.9) FROM part)}, {'name': 'p_retailprice', 'one': p_retailprice > (SELECT quantile_cont(p_retailprice, 0.9) FROM part)}], recursive := true) FROM part) WHERE one")
def quantile_binarise(spark, sf_dir):
    return relations.quantile_cells(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", ["p_size", "p_retailprice"], 0.9)


@query("SELECT c_custkey AS rid, 'c_mktsegment=' || c_mktsegment AS name FROM customer UNION SELECT c_custkey, 'c_nationkey=' || c_nationkey FROM customer")
def onehot_categories(spark, sf_dir):
    return relations.category_cells(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", ["c_mktsegment", "c_nationkey"])


def _classified_sql(table: str, key: str, columns: list[str]) -> str:
    """Every column as a feature (3 to 14 distinct values) or a label (fewer)."""
    return " UNION ALL ".join(
        f"SELECT DISTINCT {key} AS rid, '{c}=' || {c} AS name, CASE WHEN d < 3 THEN 'label' ELSE 'feature' END AS kind "
        f"FROM {table}, (SELECT count(DISTINCT {c}) AS d FROM {table}) WHERE d < 15 AND {c} IS NOT NULL" for c in columns)


@query(_classified_sql("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def csv_classification(spark, sf_dir):
    x, y = relations.csv_cells(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    return x.withColumn("kind", F.lit("feature")).unionByName(y.withColumn("kind", F.lit("label")))


U32 = "(CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query("SELECT doc_id AS rid, CASE WHEN " + U32.format("'1234|' || doc_id") + " < 0.7 THEN 'train' ELSE 'test' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return relations.hash_split(docs(spark, sf_dir).rows, 0.7)


@query("r AS (SELECT i AS rid FROM range(500) t(i)), k AS (SELECT * FROM (VALUES (0, [0, 1], [0]), (1, [2, 3], [1]), (2, [0, 4], [2])) v(k, head, tail)), c AS (SELECT rid, head FROM r, k WHERE " + U32.format("'1|r|' || rid || '|' || k") + " < 0.5), ones AS (SELECT DISTINCT rid, unnest(head) AS item FROM c), f AS (SELECT rid, item FROM r, range(5) t(item) WHERE " + U32.format("'1|x|' || rid || '|' || item") + " < 0.05) SELECT rid, CAST(item AS INT) AS item FROM (SELECT rid, item FROM ones EXCEPT SELECT rid, item FROM f) UNION ALL SELECT rid, CAST(item AS INT) FROM (SELECT rid, item FROM f EXCEPT SELECT rid, item FROM ones)")
def synthetic_rules(spark, sf_dir):
    return relations.synthetic_rules(spark, 500, [([0, 1], [0]), ([2, 3], [1]), ([0, 4], [2])], 0.05)[0]


@query(GRAPH + " SELECT u, v, c, round(proba, 6) AS proba FROM dir")
def confidence_graph(spark, sf_dir):
    return graph.confidence_graph(docs(spark, sf_dir).y).select("u", "v", "c", F.round("proba", 6).alias("proba"))


@query(GRAPH + " SELECT u, v, round(proba, 6) AS proba FROM und")
def connectivity_graph(spark, sf_dir):
    return graph.connectivity_graph(graph.confidence_graph(docs(spark, sf_dir).y)).select("u", "v", F.round("proba", 6).alias("proba"))


@query(GRAPH + " SELECT u, v, round(proba, 6) AS proba FROM und WHERE proba >= 0.3")
def pruned_edges(spark, sf_dir):
    return graph.prune(graph.connectivity_graph(graph.confidence_graph(docs(spark, sf_dir).y)), 0.3).select("u", "v", F.round("proba", 6).alias("proba"))


@query(GRAPH + " SELECT u, v, a.name AS u_name, b.name AS v_name, fa.freq AS u_freq, fb.freq AS v_freq FROM dir JOIN vocab_y a ON a.item = u JOIN vocab_y b ON b.item = v JOIN fy fa ON fa.item = u JOIN fy fb ON fb.item = v WHERE u IN (0, 1, 4, 5) AND v IN (0, 1, 4, 5)")
def named_subgraph(spark, sf_dir):
    d = docs(spark, sf_dir)
    return graph.named_subgraph(graph.confidence_graph(d.y), graph.nodes(d.y, d.vocab_y), [0, 1, 4, 5]).select("u", "v", "u_name", "v_name", "u_freq", "v_freq")


@query(DOCS + " SELECT 'label' AS kind, a.item AS a, b.item AS b, count(*) AS n FROM y a JOIN y b USING (rid) GROUP BY 2, 3 UNION ALL SELECT 'feature', a.item, b.item, count(*) FROM x a JOIN x b USING (rid) GROUP BY 2, 3 UNION ALL SELECT 'mixed', a.item, b.item, count(*) FROM y a JOIN x b USING (rid) GROUP BY 2, 3")
def cooccurrence_tables(spark, sf_dir):
    d = docs(spark, sf_dir)
    kinds = (("label", d.y, d.y), ("feature", d.x, d.x), ("mixed", d.y, d.x))
    parts = [graph.cooccurrence(a, b).select(F.lit(k).alias("kind"), "a", "b", "n") for k, a, b in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(SPACE + " SELECT array_to_string(items, ',') AS items, CAST(len AS INT) AS len, round(proba, 6) AS proba FROM space")
def probable_cliques(spark, sf_dir):
    d = docs(spark, sf_dir)
    edges = graph.connectivity_graph(graph.confidence_graph(d.y))
    return graph.probable_cliques(d.vocab_y.select(F.col("item").alias("id")), edges, LEAST).select(items_text().alias("items"), "len", F.round("proba", 6).alias("proba"))


@query(SPACE + " SELECT sid, array_to_string(items, ',') AS items, CAST(len AS INT) AS len FROM space")
def sample_space(spark, sf_dir):
    return _space(spark, sf_dir)[1].select("sid", items_text().alias("items"), "len")


@query(SPACE + ", parts AS (SELECT a.sid, a.item AS u, b.item AS v FROM ex a JOIN ex b USING (sid) WHERE a.item <> b.item) SELECT sid, CAST(any_value(len) AS INT) AS size, round(coalesce(sum(proba), 0) / any_value(len), 6) AS density, count(proba) = any_value(len) * (any_value(len) - 1) AS is_clique FROM space LEFT JOIN parts USING (sid) LEFT JOIN (SELECT u, v, proba AS proba FROM dir) d USING (u, v) GROUP BY sid".replace("coalesce(sum(proba)", "coalesce(sum(d.proba)").replace("count(proba)", "count(d.proba)"))
def subgraph_stats(spark, sf_dir):
    d, space, _ = _space(spark, sf_dir)
    return graph.subgraph_stats(graph.confidence_graph(d.y), space).select("sid", "size", F.round("density", 6).alias("density"), "is_clique")


@query(SPACE + " SELECT rid, sid FROM assign")
def containment_join_division(spark, sf_dir):
    d, space, _ = _space(spark, sf_dir)
    return sets.containment_division(d.y, space)


@query(SPACE + " SELECT rid, sid FROM assign")
def containment_join_loop(spark, sf_dir):
    d, space, _ = _space(spark, sf_dir)
    return sets.containment_loop(sets.rows_as_sets(d.y), space.select("sid", "items"))


@query(SPACE + " SELECT sid FROM space WHERE list_sort(items) = [3, 5]")
def set_search_exact(spark, sf_dir):
    return sets.search_exact(_space(spark, sf_dir)[1], [5, 3])


@query(SPACE + " SELECT sid FROM space WHERE list_has_all(items, [5])")
def set_search_supersets(spark, sf_dir):
    return sets.search_supersets(_space(spark, sf_dir)[1], [5])


@query(SPACE + " SELECT sid FROM space WHERE list_has_all([0, 1, 5, 6], items)")
def set_search_subsets(spark, sf_dir):
    return sets.search_subsets(_space(spark, sf_dir)[1], [0, 1, 5, 6])


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("w").cast("double").alias("w"), F.round("proba", 6).alias("proba"))


SUPP = SPACE + ", supp AS (SELECT sid, any_value(len) AS len, any_value(items) AS items, count(rid) AS supp FROM space LEFT JOIN assign USING (sid) GROUP BY sid)"


@query(SUPP + " SELECT sid, CAST(supp * len AS DOUBLE) AS w, round(supp * len / sum(supp * len) OVER (), 6) AS proba FROM supp")
def tail_area_distribution(spark, sf_dir):
    _, space, assign = _space(spark, sf_dir)
    return _rounded(sampling.support_distribution(assign, space, area=True), "sid")


@query(SUPP + " SELECT sid, CAST(supp AS DOUBLE) AS w, round(supp / sum(supp) OVER (), 6) AS proba FROM supp")
def tail_freq_distribution(spark, sf_dir):
    _, space, assign = _space(spark, sf_dir)
    return _rounded(sampling.support_distribution(assign, space), "sid")


UNC = SPACE + ", unc AS (SELECT rid, sid, item FROM assign JOIN ex USING (sid) WHERE item <> 0)"


@query(UNC + ", a AS (SELECT sid, count(unc.rid) AS w FROM space LEFT JOIN unc USING (sid) GROUP BY 1) SELECT sid, CAST(w AS DOUBLE) AS w, round(w / sum(w) OVER (), 6) AS proba FROM a")
def tail_uncovered_distribution(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    return _rounded(sampling.uncovered_area_distribution(assign, space, _covered(d)), "sid")


@query(UNC + ", a AS (SELECT doc_id AS rid, count(unc.sid) AS w FROM documents LEFT JOIN unc ON rid = doc_id GROUP BY 1) SELECT rid, CAST(w AS DOUBLE) AS w, round(w / sum(w) OVER (), 6) AS proba FROM a")
def covered_row_weights(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    return _rounded(sampling.row_weights(assign, space, _covered(d), d.rows), "rid")


@query(SPACE + ", unc AS (SELECT rid, sid, item FROM assign JOIN ex USING (sid)), a AS (SELECT doc_id AS rid, count(unc.sid) AS w FROM documents LEFT JOIN unc ON rid = doc_id GROUP BY 1) SELECT rid, CAST(w AS DOUBLE) AS w, round(w / sum(w) OVER (), 6) AS proba FROM a")
def row_weights(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    return _rounded(sampling.row_weights(assign, space, d.y.limit(0), d.rows), "rid")


@query(UNC + " SELECT rid, item, count(*) AS cnt FROM unc GROUP BY 1, 2")
def element_counters(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    return sampling.element_counters(assign, space, _covered(d))


HEADS = DOCS + """,
sx AS (SELECT item AS sid, count(*) AS supp FROM x GROUP BY 1),
py AS (SELECT item AS tail, count(*) AS n_pos FROM y GROUP BY 1),
plus AS (SELECT y.item AS tail, x.item AS sid, count(*) AS plus FROM x JOIN y USING (rid) GROUP BY 1, 2),
w AS (SELECT tail, sid, CAST(plus * (n - n_pos - (supp - plus)) AS DOUBLE) AS w FROM plus JOIN sx USING (sid) JOIN py USING (tail), n WHERE n_pos < n)"""


def _heads(spark, sf_dir, width=60):
    d = docs(spark, sf_dir, width)
    return sampling.head_distribution(d.x.withColumnRenamed("item", "sid"), d.y, d.n)


@query(HEADS + " SELECT tail, sid, w, round(w / sum(w) OVER (PARTITION BY tail), 6) AS proba FROM w WHERE w > 0")
def head_distribution(spark, sf_dir, width=60):
    return _rounded(_heads(spark, sf_dir, width), "tail", "sid")


@query(HEADS + ", d AS (SELECT CAST(i AS INT) AS draw FROM range(50) t(i)), s AS (SELECT tail, draw, sid, ln(w) - ln(-ln(" + U32.format("'7|' || draw || '|' || tail || '|' || sid") + ")) AS g FROM w, d WHERE w > 0) SELECT tail, draw, arg_max(sid, g) AS sid FROM s GROUP BY 1, 2")
def draw_gumbel(spark, sf_dir):
    return sampling.draw_per_group(_heads(spark, sf_dir).select("tail", "sid", "w"), 50, 7, "tail", "sid")


@query(SUPP + ", p AS (SELECT sid, supp * len / sum(supp * len) OVER () AS proba FROM supp), c AS (SELECT sid, proba, sum(proba) OVER (ORDER BY sid) AS hi FROM p WHERE proba > 0), d AS (SELECT i AS draw, " + U32.format("'5|' || i") + " AS u FROM range(2000) t(i)) SELECT draw, sid FROM d JOIN c ON u >= hi - proba AND u < hi")
def draw_inverse_cdf(spark, sf_dir):
    _, space, assign = _space(spark, sf_dir)
    return sampling.draw_inverse(sampling.support_distribution(assign, space, area=True).select("sid", "w"), 2000, 5, "sid")


LINES = """s AS (SELECT l_orderkey AS rid, list_sort(list_distinct(list(CAST(l_partkey % 12 AS INT)))) AS items FROM lineitem GROUP BY 1),
m AS (SELECT rid, items, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS mask FROM s),
p AS (SELECT rid, [items[b + 1] FOR b IN range(len(items)) IF (mask >> b) & 1 = 1] AS own FROM m),
a AS (SELECT rid, array_to_string(own, ',') AS items, len(own) AS len FROM p)"""


def _orders(spark, sf_dir):
    """Parts of orders by their key's remainder; an order has up to seven of twelve."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sets.rows_as_sets(table.select(F.col("l_orderkey").alias("rid"), (F.col("l_partkey") % 12).cast("int").alias("item")))


@query(LINES + ", c AS (SELECT items, count(*) AS n FROM a GROUP BY 1) SELECT items, CAST(n AS DOUBLE) AS w, round(n / sum(n) OVER (), 6) AS proba FROM c")
def boley_freq(spark, sf_dir):
    return _rounded(sampling.powerset_distribution(_orders(spark, sf_dir)).withColumn("items", items_text()), "items")


@query(LINES + ", c AS (SELECT items, count(*) * any_value(len) AS n FROM a GROUP BY 1) SELECT items, CAST(n AS DOUBLE) AS w, round(n / sum(n) OVER (), 6) AS proba FROM c")
def boley_area(spark, sf_dir):
    return _rounded(sampling.powerset_distribution(_orders(spark, sf_dir), area=True).withColumn("items", items_text()), "items")


@query(LINES + ", t AS (SELECT rid, rid % 5 = 0 AS y FROM s), c AS (SELECT items, count(*) FILTER (y) * ((SELECT count(*) FROM t WHERE NOT y) - count(*) FILTER (NOT y)) AS n FROM a JOIN t USING (rid) GROUP BY 1) SELECT items, CAST(n AS DOUBLE) AS w, round(n / sum(n) OVER (), 6) AS proba FROM c WHERE n > 0")
def boley_head_distribution(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return _rounded(sampling.powerset_heads(rows, rows.where("rid % 5 = 0")).withColumn("items", items_text()), "items")


#: Nations and the residues of customer keys that are more frequent in them than the average.
NATIONS = """t AS (SELECT c_nationkey, c_custkey % {0} AS item, count(*) AS c FROM customer GROUP BY 1, 2),
f AS (SELECT CAST(c_nationkey AS BIGINT) AS rid, CAST(item AS INT) AS item FROM (SELECT *, sum(c) OVER (PARTITION BY c_nationkey) AS total FROM t) WHERE c * {0} > total)"""
PAIR = NATIONS.format(8) + """, r AS (SELECT rid, list(item) AS items FROM f GROUP BY 1),
p AS (SELECT a.rid AS pos, b.rid AS neg, a.items AS p, b.items AS q, len(list_filter(a.items, lambda i: NOT list_contains(b.items, i))) AS d, len(list_intersect(a.items, b.items)) AS i FROM r a, r b WHERE a.rid < 8 AND b.rid >= 8)"""


def _frequent_residues(spark, sf_dir, k: int) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey", (F.col("c_custkey") % k).cast("int").alias("item")).agg(F.count("*").alias("c"))
    total = own.groupBy("c_nationkey").agg(F.sum("c").alias("total"))
    return own.join(total, "c_nationkey").where(F.col("c") * k > F.col("total")).select(F.col("c_nationkey").cast("long").alias("rid"), "item")


def _nations(spark, sf_dir):
    return sets.rows_as_sets(_frequent_residues(spark, sf_dir, 8))


@query(PAIR + " SELECT pos, neg, CAST(d AS DOUBLE) AS w, round(d / sum(d) OVER (), 6) AS proba FROM p WHERE d > 0")
def pair_distribution(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    return _rounded(sampling.pair_distribution(rows, rows.where("rid < 8")), "pos", "neg")


@query(PAIR + ", q AS (SELECT pos, neg, (pow(2, d) - 1) * pow(2, i) AS w FROM p WHERE d > 0) SELECT pos, neg, CAST(w AS DOUBLE) AS w, round(w / sum(w) OVER (), 6) AS proba FROM q")
def boley_pair_distribution(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    return _rounded(sampling.pair_distribution(rows, rows.where("rid < 8"), full=True), "pos", "neg")


#: A subset that is not empty: its first item by a truncated geometric draw, the later ones by halves.
FILLED = """CASE WHEN len({own}) > 0 THEN list_concat([{own}[{first}]], list_filter({own}[{first} + 1:], lambda i: {u} < 0.5)) END"""
FIRST = "CAST(least(floor(-log2(1 - {u} * (1 - pow(2, -len({own}))))) + 1, len({own})) AS INT)"


@query(PAIR + ", o AS (SELECT *, list_sort(list_filter(p, lambda i: NOT list_contains(q, i))) AS own, list_intersect(p, q) AS common FROM p WHERE d > 0), fi AS (SELECT *, "
       + FIRST.format(u=U32.format("'9|' || pos || '|' || neg || '|first'"), own="own") + " AS first FROM o), re AS (SELECT pos, neg, "
       + FILLED.format(own="own", first="first", u=U32.format("'9|' || pos || '|' || neg || '|' || i")) + " AS own, list_filter(common, lambda i: "
       + U32.format("'9|' || pos || '|' || neg || '|both|' || i") + " < 0.5) AS b FROM fi) SELECT pos, neg, array_to_string(list_sort(list_concat(own, b)), ',') AS pattern FROM re")
def pair_pattern_draw(spark, sf_dir):
    """All pairs of nations that differ: 25 rows, an input of fixed size."""
    rows = _nations(spark, sf_dir)
    pos = rows.where("rid < 8").select(F.col("rid").alias("pos"), F.col("items").alias("p"))
    pairs = pos.join(rows.where("rid >= 8").select(F.col("rid").alias("neg"), F.col("items").alias("q")), F.size(F.array_except("p", "q")) > 0)
    return sampling.pair_patterns(pairs, 9, "pos", "neg").select("pos", "neg", items_text("pattern").alias("pattern"))


@query(LINES + " SELECT rid, CASE WHEN rid % 5 = 0 THEN CAST(len(items) AS DOUBLE) ELSE 1 END AS tight, round(sqrt(CASE WHEN rid % 5 = 0 THEN len(items) ELSE 12 - len(items) END), 6) AS original FROM s")
def proposal_weights(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return sampling.proposal_weights(rows, rows.where("rid % 5 = 0"), 12).select("rid", "tight", F.round("original", 6).alias("original"))


@query(LINES + " SELECT rid, round(len(items) * ln(2), 6) AS log_freq, round(ln(len(items)) + (len(items) - 1) * ln(2), 6) AS log_area FROM s")
def row_pattern_weights(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    both = sampling.row_pattern_log_weights(rows).join(sampling.row_pattern_log_weights(rows, True).withColumnRenamed("log_w", "log_area"), "rid")
    return both.select("rid", F.round("log_w", 6).alias("log_freq"), F.round("log_area", 6).alias("log_area"))


@query(NATIONS.format(8) + """, r AS (SELECT rid, list(item) AS items FROM f GROUP BY 1),
e AS (SELECT user_id AS chain, event_id, CAST(user_id % 25 AS INT) AS pos, CAST(event_id * 7 % 25 AS INT) AS neg FROM events),
s AS (SELECT chain, CAST(event_id AS INT) AS step, pos, neg, CAST(coalesce(len(list_filter(a.items, lambda i: NOT list_contains(coalesce(b.items, []), i))), 0) AS DOUBLE) AS w,
  CAST(greatest(coalesce(len(a.items), 0), 1) AS DOUBLE) AS bound, """
       + U32.format("'3|' || event_id") + """ AS u, row_number() OVER (PARTITION BY chain ORDER BY event_id) AS k FROM e LEFT JOIN r a ON a.rid = pos LEFT JOIN r b ON b.rid = neg),
fold(chain, k, step, pos, neg, w, bound, ratio, accepted) AS (SELECT DISTINCT chain, CAST(0 AS BIGINT), 0, 0, 0, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), false FROM s UNION ALL
  SELECT chain, k, step, pos, neg, CASE WHEN u < ratio THEN w ELSE old_w END, CASE WHEN u < ratio THEN bound ELSE old_bound END, ratio, u < ratio
  FROM (SELECT s.*, o.w AS old_w, o.bound AS old_bound, s.w * o.bound / (s.bound * o.w) AS ratio FROM fold o JOIN s ON s.chain = o.chain AND s.k = o.k + 1))
SELECT chain, step, pos, neg, round(ratio, 6) AS ratio, accepted FROM fold WHERE k > 0""")
def cftp_trace(spark, sf_dir):
    """One chain per user over all events: candidates are pairs of nations, weighted by the items that only the first has, bounded by all its items."""
    rows = _nations(spark, sf_dir)
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("chain"), "event_id", (F.col("user_id") % 25).cast("int").alias("pos"), (F.col("event_id") * 7 % 25).cast("int").alias("neg"))
    # 25 rows
    steps = steps.join(F.broadcast(rows.select(F.col("rid").alias("pos"), F.col("items").alias("p"))), "pos", "left")
    steps = steps.join(F.broadcast(rows.select(F.col("rid").alias("neg"), F.col("items").alias("q"))), "neg", "left")
    none = F.array().cast("array<int>")
    steps = steps.select("chain", F.col("event_id").cast("int").alias("step"), "pos", "neg", F.size(F.array_except(F.coalesce("p", none), F.coalesce("q", none))).alias("w"),
                         F.greatest(F.size(F.coalesce("p", none)), F.lit(1)).alias("bound"), uniform(F.lit(3), F.col("event_id")).alias("u"))
    return sampling.chain_trace(steps, "chain").withColumn("ratio", F.round("ratio", 6))


@query(TOP + ", a AS (SELECT rule_id, count(*) AS a FROM cells GROUP BY 1), s AS (SELECT p.rule_id AS r1, q.rule_id AS r2, count(*) AS i FROM cells p JOIN cells q USING (rid, item) WHERE p.rule_id < q.rule_id GROUP BY 1, 2) SELECT p.rule_id AS r1, q.rule_id AS r2, round(1 - coalesce(i / (p.a + q.a - i), 0), 6) AS distance FROM a p JOIN a q ON p.rule_id < q.rule_id LEFT JOIN s ON r1 = p.rule_id AND r2 = q.rule_id")
def rule_distance(spark, sf_dir):
    d, top = docs(spark, sf_dir), _top(spark, sf_dir, 20)
    return rules.distances(rules.rectangles(top, d.x, d.y), top).select("r1", "r2", F.round("distance", 6).alias("distance"))


@query(TOP + " SELECT rule_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cells c WHERE c.rule_id < 3 AND c.rid = o.rid AND c.item = o.item)) AS uncovered FROM cells o GROUP BY 1")
def marginal_coverage(spark, sf_dir):
    d, top = docs(spark, sf_dir), _top(spark, sf_dir, 20)
    cells = rules.rectangles(top, d.x, d.y)
    return rules.marginal_coverage(cells, cells.where("rule_id < 3"))


@query(TOP + " SELECT round((SELECT count(*) FROM (SELECT DISTINCT rid, item FROM cells)) / (SELECT count(*) FROM y), 6) AS ratio")
def coverage_ratio(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rules.coverage_ratio(rules.rectangles(_top(spark, sf_dir, 20), d.x, d.y), d.y).select(F.round("ratio", 6).alias("ratio"))


@query(TOP + " SELECT rule_id, support, head_support, tail_support, round(p, 6) AS precision, round(kl, 6) AS kl FROM top JOIN stats USING (h, t)")
def bound_rules(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rules.statistics(_top(spark, sf_dir, 20), d.x, d.y, d.n).select("rule_id", "support", "head_support", "tail_support", F.round("precision", 6).alias("precision"), F.round("kl", 6).alias("kl"))


@query(TOP + " SELECT rule_id, v.name || ' -> ' || w.name AS text FROM top JOIN vocab v ON v.item = h JOIN vocab_y w ON w.item = t")
def rule_summaries(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rules.summary(_top(spark, sf_dir, 20), d.vocab_x, d.vocab_y)


@query(TOP + " SELECT DISTINCT x.rid, t AS item FROM x JOIN top ON x.item = h")
def predict(spark, sf_dir):
    return greedy.predict(docs(spark, sf_dir).x, _top(spark, sf_dir, 20))


METRIC = TOP + """,
pred AS (SELECT DISTINCT x.rid, t AS item FROM x JOIN top ON x.item = h),
b AS (SELECT rid, item, max(p) AS p, max(t) AS t FROM (SELECT rid, item, 1 AS p, 0 AS t FROM pred UNION ALL SELECT rid, item, 0, 1 FROM y) GROUP BY 1, 2),
l AS (SELECT v.item, coalesce(sum(p * t), 0) AS tp, coalesce(sum(p * (1 - t)), 0) AS fp, coalesce(sum((1 - p) * t), 0) AS fn FROM vocab_y v LEFT JOIN b USING (item) GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS re FROM l),
s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS l, avg(pr) AS macro_precision, avg(re) AS macro_recall, avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END) AS macro_f1 FROM pr),
e AS (SELECT s.*, n, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS mp, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS mr, (SELECT count(DISTINCT rid) FROM b WHERE p <> t) AS wrong FROM s, n),
r AS (SELECT round(1 - (fp + fn) / (n * l), 6) AS hamming_accuracy, round(1 - wrong / n, 6) AS subset_accuracy, round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(CASE WHEN mp + mr = 0 THEN 0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS micro_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1 FROM e)"""


def _report(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = evaluation.report(greedy.predict(d.x, _top(spark, sf_dir, 20)), d.y, d.vocab_y, d.n)
    return found.select(*(F.round(m, 6).alias(m) for m in evaluation.METRICS))


@query(METRIC + " SELECT * FROM r")
def metrics_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query(METRIC + " SELECT metric, CAST(score AS DOUBLE) AS score FROM (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE score)")
def metrics_long(spark, sf_dir):
    return evaluation.melted(_report(spark, sf_dir), [], list(evaluation.METRICS))


TAIL = SUPP + """, tot AS (SELECT sid, sum(d.proba) AS total FROM (SELECT a.sid, a.item AS u, b.item AS v FROM ex a JOIN ex b USING (sid) WHERE a.item <> b.item) JOIN dir d USING (u, v) GROUP BY 1),
rep AS (SELECT sid, supp AS support_size, round(supp / n, 6) AS frequency, supp * len AS area, len AS length, round(coalesce(total, 0) / len, 6) AS edge_density, round(CASE WHEN len > 1 THEN coalesce(total, 0) / (len * (len - 1)) END, 6) AS edge_ratio FROM supp LEFT JOIN tot USING (sid), n)"""


def _tails(spark, sf_dir):
    d, space, assign = _space(spark, sf_dir)
    found = evaluation.tail_report(space.select("sid", "items"), assign, graph.confidence_graph(d.y), d.n)
    return found.select("sid", "support_size", F.round("frequency", 6).alias("frequency"), "area", "length", F.round("edge_density", 6).alias("edge_density"), F.round("edge_ratio", 6).alias("edge_ratio"))


@query(TAIL + " SELECT * FROM rep")
def tail_report(spark, sf_dir):
    return _tails(spark, sf_dir)


@query(TAIL + " SELECT sid, metric, CAST(score AS DOUBLE) AS score FROM (UNPIVOT (SELECT sid, CAST(support_size AS DOUBLE) AS support_size, CAST(area AS DOUBLE) AS area, edge_density FROM rep) ON support_size, area, edge_density INTO NAME metric VALUE score)")
def tail_report_long(spark, sf_dir):
    return evaluation.melted(_tails(spark, sf_dir), ["sid"], ["support_size", "area", "edge_density"])


def _described(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "count", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


DESCRIBE = "count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(CAST(min({0}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont({0}, 0.25) AS DOUBLE), 6) AS p25, round(CAST(quantile_cont({0}, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_cont({0}, 0.75) AS DOUBLE), 6) AS p75, round(CAST(max({0}) AS DOUBLE), 6) AS max"


@query(TAIL + " SELECT length, " + DESCRIBE.format("area") + " FROM rep GROUP BY 1")
def tail_report_describe(spark, sf_dir):
    return _described(evaluation.describe(_tails(spark, sf_dir), ["length"], "area"), "length")


@query("SELECT o_orderpriority, " + DESCRIBE.format("o_totalprice") + " FROM orders GROUP BY 1")
def grouped_describe(spark, sf_dir):
    return _described(evaluation.describe(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority"], "o_totalprice"), "o_orderpriority")


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std FROM part GROUP BY 1, 2")
def ranked_runs(spark, sf_dir):
    found = evaluation.ranked(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand", "p_type"], "p_retailprice")
    return found.select("p_brand", "p_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("c AS (SELECT l_linenumber, max(l_extendedprice) FILTER (l_returnflag = 'A') AS one, max(l_extendedprice) FILTER (l_returnflag = 'R') AS other FROM lineitem GROUP BY 1) SELECT l_linenumber, one, other, round((one - other) / other, 6) AS difference FROM c")
def relative_difference(spark, sf_dir):
    found = evaluation.relative_difference(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_linenumber", "l_returnflag", "l_extendedprice", "A", "R")
    return found.select("l_linenumber", "one", "other", F.round("difference", 6).alias("difference"))


@query("SELECT event_type, round(count(*) FILTER (value > 10) / count(*), 6) AS share FROM events GROUP BY 1")
def convergence_ratio(spark, sf_dir):
    return evaluation.share_where(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], F.col("value") > 10).select("event_type", F.round("share", 6).alias("share"))


@query(LINES + " SELECT rid, round(pow(2, len(items)) / sum(pow(2, len(items))) OVER () * 1e6, 4) AS share FROM s")
def row_skew(spark, sf_dir):
    weights = _orders(spark, sf_dir).select("rid", F.pow(F.lit(2.0), F.size("items")).alias("w"))
    return sampling.normalised(weights).select("rid", F.round(F.col("proba") * 1e6, 4).alias("share"))


@query("""a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS p, sum(n) OVER (PARTITION BY c_mktsegment) / sum(n) OVER () AS q FROM a)
SELECT c_nationkey, c_mktsegment, round(CASE WHEN p <= q THEN 0 ELSE p * ln(p / q) + CASE WHEN p >= 1 THEN 0 ELSE (1 - p) * ln((1 - p) / (1 - q)) END END, 6) AS kl FROM s""")
def kl_segments(spark, sf_dir):
    """How far a nation's share of each segment is above the share over all."""
    from pyspark.sql import Window

    own = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    # one row per nation and segment
    total = lambda *c: F.sum("n").over(Window.partitionBy(*(c or [F.lit(0)])))
    kl = kl_bernoulli(F.col("n") / total("c_nationkey"), total("c_mktsegment") / total())
    return own.select("c_nationkey", "c_mktsegment", F.round(kl, 6).alias("kl"))


@query(LINES + " SELECT DISTINCT items FROM a")
def powersets(spark, sf_dir):
    return sampling.powerset_assign(_orders(spark, sf_dir)).select(items_text().alias("items")).distinct()


VOTE = "m AS (SELECT DISTINCT l_orderkey % 9 AS cluster, l_orderkey AS rid FROM lineitem), cells AS (SELECT DISTINCT l_orderkey AS rid, CAST(l_suppkey % 12 AS INT) AS item FROM lineitem)"


@query(VOTE + ", z AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1) SELECT cluster, item FROM cells JOIN m USING (rid) JOIN z USING (cluster) GROUP BY cluster, item HAVING count(*) > 0.3 * any_value(size)")
def majority_vote(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    members = lines.select(F.col("l_orderkey").alias("rid"), (F.col("l_orderkey") % 9).alias("cluster")).distinct()
    cells = lines.select(F.col("l_orderkey").alias("rid"), (F.col("l_suppkey") % 12).cast("int").alias("item")).distinct()
    return bicluster.majority_vote(cells, members, 0.3)


BLOCKS = NATIONS.format(3) + ", m AS (SELECT rid AS id, item AS cluster FROM f), g AS (SELECT id, list_sort(list(cluster)) AS clusters FROM m GROUP BY 1), b AS (SELECT CAST(row_number() OVER (ORDER BY clusters) - 1 AS INT) AS block, clusters, list_sort(list(id)) AS ids FROM g GROUP BY clusters)"


def _blocks(spark, sf_dir):
    return bicluster.blocks(_frequent_residues(spark, sf_dir, 3).select(F.col("rid").alias("id"), F.col("item").alias("cluster")))


@query(BLOCKS + " SELECT block, array_to_string(clusters, ',') AS clusters, array_to_string(ids, ',') AS ids FROM b")
def blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block", items_text("clusters").alias("clusters"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(BLOCKS + " SELECT DISTINCT p.block AS l, q.block AS r, CAST(len(p.ids) * len(q.ids) AS BIGINT) AS area FROM b p JOIN b q ON len(list_intersect(p.clusters, q.clusters)) > 0")
def block_adjacency(spark, sf_dir):
    found = _blocks(spark, sf_dir)
    return bicluster.adjacency(found, found)


@query(TOP + ", a AS (SELECT rule_id, count(*) AS mc FROM cells GROUP BY 1) SELECT rule_id, mc, round(mc * kl, 6) AS v1, round(sqrt(mc) * kl, 6) AS v3, round(CASE WHEN mc > 0 THEN kl ELSE 0 END + 10 * mc, 6) AS submod FROM top JOIN stats USING (h, t) JOIN a USING (rule_id)")
def greedy_first_step(spark, sf_dir):
    d, top = docs(spark, sf_dir), _top(spark, sf_dir, 20)
    stats = rules.statistics(top, d.x, d.y, d.n).select("rule_id", "head", "tail", "kl")
    cells = rules.rectangles(top, d.x, d.y)
    none = stats.select("rule_id", F.lit(0.0).alias("div"))
    scored = [greedy.step_scores(stats, cells, cells.select("rid", "item").limit(0), none, greedy.Config(version=v)).select("rule_id", "mc", F.round("objective", 6).alias(v)) for v in ("v1", "v3", "submod")]
    return scored[0].join(scored[1].drop("mc"), "rule_id").join(scored[2].drop("mc"), "rule_id")


#: Objectives over mc, kl and div as in the learners, with the weight of the last term.
GREEDY = {"v1": ("mc * kl + 10 * div", 10.0), "v2": ("mc * kl + 10 * div", 10.0), "v3": ("sqrt(mc) * kl + div", 1.0), "submod": ("CASE WHEN mc > 0 THEN kl ELSE 0 END + 0.01 * mc", 0.01)}


def _greedy_sql(objective: str, budget: int) -> str:
    """The selection with its steps written out."""
    parts = [TOP, """st AS MATERIALIZED (SELECT rule_id, h, t, kl FROM top JOIN stats USING (h, t)), cl AS MATERIALIZED (SELECT * FROM cells), ar AS (SELECT rule_id, count(*) AS a FROM cl GROUP BY 1),
        meet AS (SELECT p.rule_id AS r, q.rule_id AS s, count(*) AS i FROM cl p JOIN cl q USING (rid, item) GROUP BY 1, 2),
        far AS MATERIALIZED (SELECT a.rule_id AS r, b.rule_id AS s, 1 - coalesce(i / (a.a + b.a - i), 0) AS d FROM ar a CROSS JOIN ar b LEFT JOIN meet ON r = a.rule_id AND s = b.rule_id),
        b0 AS (SELECT 0 AS step, CAST(-1 AS BIGINT) AS rule_id, CAST(0 AS DOUBLE) AS objective, CAST(0 AS BIGINT) AS mc)"""]
    for k in range(1, budget + 1):
        parts.append(f"""c{k} AS MATERIALIZED (SELECT DISTINCT rid, item FROM cl JOIN b{k - 1} USING (rule_id)),
        m{k} AS (SELECT rule_id, count(*) AS mc FROM cl ANTI JOIN c{k} USING (rid, item) GROUP BY 1), d{k} AS (SELECT r AS rule_id, sum(d) AS div FROM far WHERE s IN (SELECT rule_id FROM b{k - 1}) GROUP BY 1),
        o{k} AS (SELECT rule_id, h, t, kl, coalesce(m{k}.mc, 0) AS mc, coalesce(div, 0) AS div FROM st LEFT JOIN m{k} USING (rule_id) LEFT JOIN d{k} USING (rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM b{k - 1})),
        b{k} AS MATERIALIZED (SELECT * FROM b{k - 1} UNION ALL (SELECT {k}, rule_id, {objective} AS objective, mc FROM o{k} ORDER BY objective DESC, t, h LIMIT 1))""")
    return "WITH " + ",\n".join(parts).strip() + f" SELECT CAST(step - 1 AS INT) AS step, rule_id, round(objective, 6) AS objective, mc FROM b{budget} WHERE step > 0"


def _greedy(version: str, lambd: float):
    def run(spark, sf_dir):
        d = docs(spark, sf_dir)
        found = greedy.select(_top(spark, sf_dir, 20), d.x, d.y, d.n, greedy.Config(version=version, lambd=lambd, n_max_rules=4), 4)
        return found.frame(spark).select("step", "rule_id", F.round("objective", 6).alias("objective"), "mc")

    return run


for _version, (_objective, _lambd) in GREEDY.items():
    QUERIES[f"greedy_{_version}"] = _greedy(_version, _lambd)
    ORACLES[f"greedy_{_version}"] = _greedy_sql(_objective, 4)


#: Queries whose work and output are linear in the cells, again over all tokens.
LINEAR = (rule_stats, rule_topk, item_frequency, rows_as_sets, filter_rows_with_labels, dataset_shape, head_distribution)


def _all_tokens(fn):
    return lambda spark, sf_dir: fn(spark, sf_dir, width=None)


for _fn in LINEAR:
    QUERIES[f"{_fn.__name__}_all"] = _all_tokens(_fn)
    ORACLES[f"{_fn.__name__}_all"] = ORACLES[_fn.__name__].replace(" LIMIT 60)", ")", 1)


@query(DOCS.replace(" LIMIT 60)", ")") + " SELECT name, rid // 65536 AS block, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS rids FROM x JOIN vocab USING (item) GROUP BY 1, 2")
def token_index_all(spark, sf_dir):
    """Posting lists of all tokens, in blocks of row numbers."""
    d = docs(spark, sf_dir, None)
    return sets.inverted_index(d.x).join(d.vocab_x, "item").select("name", "block", F.array_join(F.transform("rids", lambda r: r.cast("string")), ",").alias("rids"))


from ruleloom import catalogue_learning  # noqa: E402, F401  it registers more queries
