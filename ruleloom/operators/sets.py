"""Set views, conjunctive filters, containment joins and set search over cells ``(rid, item)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.sources.scratch import stored


def rows_as_sets(cells: DataFrame) -> DataFrame:
    """``rid, items`` sorted; a row without cells is absent."""
    return cells.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def cells_of_sets(sets: DataFrame) -> DataFrame:
    return sets.select("rid", F.explode("items").alias("item")).distinct()


def inverted_index(cells: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``item, block, rids``: posting lists in blocks of ``width`` consecutive row numbers, so that no list grows with the table."""
    return cells.groupBy("item", F.floor(F.col("rid") / width).alias("block")).agg(F.array_sort(F.collect_set("rid")).alias("rids"))


def frequency(cells: DataFrame) -> DataFrame:
    """Rows of each item; cells are distinct, as relations hold them."""
    return cells.groupBy("item").agg(F.count("*").alias("freq"))


def ordering(cells: DataFrame) -> DataFrame:
    """Items by frequency, most common first, ties by item."""
    return frequency(cells).orderBy(F.desc("freq"), "item")


def labelled_rows(x: DataFrame, y: DataFrame) -> DataFrame:
    """Feature cells of the rows that have a label."""
    return x.join(y.select("rid").distinct(), "rid", "left_semi")


def having_all(cells: DataFrame, items: list[int]) -> DataFrame:
    """Rows that have every item: relational division by a list."""
    if not items:
        raise ValueError("no items")
    return cells.where(F.col("item").isin(items)).groupBy("rid").agg(F.count_distinct("item").alias("k")).where(F.col("k") == len(set(items))).select("rid")


def support_size(cells: DataFrame, items: list[int]) -> int:
    return having_all(cells, items).count()


def containment_division(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """``rid, sid`` of each set contained in a row: equi-join on items, then a count equal to the set's size.

    Cells are distinct, as relations hold them. Work follows the matching (row, item, set) triples, never all pairs of rows and sets. Empty
    sets have no match.
    """
    own = sets.select("sid", F.array_distinct("items").alias("items"))
    parts = own.select("sid", F.size("items").alias("len"), F.explode("items").alias("item"))
    single = parts.where("len = 1").select("sid", "item")
    several = parts.where("len > 1")
    counted = cells.join(several, "item").groupBy("rid", "sid", "len").agg(F.count("*").alias("k")).where("k = len").select("rid", "sid")
    # a set of one item needs no count
    return cells.join(single, "item").select("rid", "sid").unionByName(counted)


def containment_prefix(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """The same along shared prefixes: sets are ordered by rising item frequency, and each distinct prefix is met with the rows once.

    Level by level the rows of a prefix are joined with the cells of the next item, so sets with a common beginning share its join and a rare
    first item leaves few rows. One job per level, of as many levels as the longest set has items.
    """
    rank = frequency(cells).select("item", F.struct("freq", "item").alias("rank"))
    # an item that no row has comes first and ends its sets at once
    parts = sets.select("sid", F.explode(F.array_distinct("items")).alias("item")).join(rank, "item", "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").isNotNull().alias("known"), "rank", "item"))), lambda x: x["item"])
    ordered = stored(parts.groupBy("sid").agg(order.alias("items")))
    longest = ordered.agg(F.max(F.size("items"))).first()[0] or 0
    level, out = None, cells.select("rid", F.lit(None).cast(ordered.schema["sid"].dataType).alias("sid")).limit(0)
    for k in range(1, longest + 1):
        here = ordered.where(F.size("items") >= k).select(F.slice("items", 1, k).alias("prefix")).distinct().withColumn("item", F.element_at("prefix", k))
        if level is None:
            grown = cells.join(here, "item").select("rid", "prefix")
        else:
            there = here.withColumn("before", F.slice("prefix", 1, k - 1))
            grown = level.withColumnRenamed("prefix", "before").join(there, "before").select("rid", "prefix", "item").join(cells, ["rid", "item"]).select("rid", "prefix")
        level = stored(grown)
        whole = ordered.where(F.size("items") == k).select("sid", F.col("items").alias("prefix"))
        out = out.unionByName(level.join(whole, "prefix").select("rid", "sid"))
    return out


#: Pairs of rows and sets that the nested loop takes.
MOST_PAIRS = 50_000_000


def containment_loop(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The same by a nested loop over all pairs: a check for small inputs; more than ``MOST_PAIRS`` raise ``ValueError``."""
    if rows.count() * sets.count() > MOST_PAIRS:
        raise ValueError("too many pairs for a nested loop")
    return rows.join(sets.withColumnRenamed("items", "own"), F.size(F.array_except("own", "items")) == 0).where("size(own) > 0").select("rid", "sid")


def _as_array(query: list[int]) -> Column:
    return F.array(*(F.lit(i) for i in sorted(set(query)))).cast("array<int>")


def search_exact(sets: DataFrame, query: list[int]) -> DataFrame:
    """Sets equal to the query; none for an empty one."""
    return sets.where(F.array_sort(F.array_distinct("items")) == _as_array(query)).select("sid") if query else sets.select("sid").limit(0)


def search_supersets(sets: DataFrame, query: list[int]) -> DataFrame:
    if not query:
        raise ValueError("an empty query has every set as superset")
    return sets.where(F.size(F.array_except(_as_array(query), "items")) == 0).select("sid")


def search_subsets(sets: DataFrame, query: list[int]) -> DataFrame:
    """Non-empty sets within the query; none for an empty one."""
    return sets.where((F.size("items") > 0) & (F.size(F.array_except("items", _as_array(query))) == 0)).select("sid")


def cells_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def items_of(x: DataFrame, target: DataFrame) -> DataFrame:
    """``item``: items of at least one row of ``target(rid)``."""
    return x.join(target.select("rid"), "rid", "left_semi").select("item").distinct()


def compact(ids: DataFrame) -> DataFrame:
    """``old, new``: distinct ids of a vocabulary, numbered from 0 in their order."""
    from pyspark.sql import Window

    return ids.select(F.col("item").alias("old")).distinct().withColumn("new", (F.row_number().over(Window.orderBy("old")) - 1).cast("int"))


def first_of_permutation(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``place, <key>``: the first ``k`` of a random order of ``rows``."""
    from pyspark.sql import Window

    from ruleloom.functions.scalar import uniform

    drawn = rows.select(key, uniform(F.lit(seed), F.col(key)).alias("u")).orderBy("u", key).limit(k)
    return drawn.select((F.row_number().over(Window.orderBy("u", key)) - 1).cast("int").alias("place"), key)
