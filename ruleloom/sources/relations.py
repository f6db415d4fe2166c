"""Feature and label relations: long cells ``(rid, item)`` with vocabularies, from tables or the driver's files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Dataset:
    """Aligned feature cells ``x`` and label cells ``y`` over ``rows(rid)``; vocabularies are ``(item, name)``."""

    x: DataFrame
    y: DataFrame
    rows: DataFrame
    vocab_x: DataFrame
    vocab_y: DataFrame
    n: int

    def shape(self) -> DataFrame:
        """Rows (empty ones too), vocabulary sizes and number of cells."""
        return self.rows.agg(F.count("*").alias("n_rows")).crossJoin(self.vocab_x.agg(F.count("*").alias("n_features"))).crossJoin(
            self.vocab_y.agg(F.count("*").alias("n_labels"))).crossJoin(self.x.agg(F.count("*").alias("nnz_x"))).crossJoin(self.y.agg(F.count("*").alias("nnz_y")))

    def check(self) -> None:
        """Raise ``ValueError`` when a cell names an unknown row or item."""
        for cells, vocab in ((self.x, self.vocab_x), (self.y, self.vocab_y)):
            if not cells.join(self.rows, "rid", "left_anti").isEmpty() or not cells.join(vocab, "item", "left_anti").isEmpty():
                raise ValueError("cells outside the rows or the vocabulary")


def numbered(names: DataFrame) -> DataFrame:
    """Vocabulary ``(item, name)`` of distinct names in name order. A vocabulary fits one task."""
    return names.select((F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("item"), "name")


def dataset(x_names: DataFrame, y_names: DataFrame, rows: DataFrame) -> Dataset:
    """Dictionary-encode cells ``(rid, name)``."""
    vx, vy = (numbered(d.select("name").distinct()).persist(StorageLevel.MEMORY_AND_DISK) for d in (x_names, y_names))
    x, y = (d.join(v, "name").select("rid", "item").distinct() for d, v in ((x_names, vx), (y_names, vy)))
    return Dataset(x, y, rows, vx, vy, rows.count())


def toy(spark: SparkSession) -> Dataset:
    """Three rows, three features, two labels."""
    cells = "rid long, item int"
    x = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 2)], cells)
    y = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], cells)
    names = "item int, name string"
    return Dataset(x, y, spark.range(3).toDF("rid"), spark.createDataFrame([(i, f"f{i}") for i in range(3)], names), spark.createDataFrame([(i, f"l{i}") for i in range(2)], names), 3)


def input_stamp(spark: SparkSession, *paths: str) -> tuple:
    """Lengths and modification times of files, so that what is kept for them is dropped when they change."""
    jvm, out = spark.sparkContext._jvm, []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
        out.append((path, status.getLen(), status.getModificationTime()))
    return tuple(out)


class Kept:
    """Values kept for a session and a state of the input files; an older state's value is released when a new one comes."""

    def __init__(self, release):
        self.values: dict[tuple, tuple] = {}
        self.release = release

    def get(self, spark: SparkSession, files: list[str], key: tuple, make):
        key = (spark.sparkContext.applicationId, *key)
        stamp = input_stamp(spark, *files)
        if key in self.values and self.values[key][0] != stamp:
            self.release(self.values.pop(key)[1])
        if key not in self.values:
            self.values[key] = (stamp, make())
        return self.values[key][1]

    def clear(self) -> None:
        while self.values:
            self.release(self.values.popitem()[1][1])


def _unpersist(found: Dataset) -> None:
    for frame in (found.x, found.y, found.vocab_x, found.vocab_y):
        frame.unpersist()


_DOCS = Kept(_unpersist)


def docs(spark: SparkSession, sf_dir: str, width: int | None = 60) -> Dataset:
    """Documents as rows: the ``width`` tokens of most documents are features, or all tokens where it is None; language,
    quality and toxicity are labels. Kept for the session until the files change or ``release_docs`` is called."""
    files = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")]
    return _DOCS.get(spark, files, (sf_dir, width), lambda: _docs(spark, sf_dir, width))


def release_docs() -> None:
    """Let go of the relations kept for documents."""
    _DOCS.clear()


def _docs(spark: SparkSession, sf_dir: str, width: int | None) -> Dataset:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tokens = table.select(F.col("doc_id").alias("rid"), F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))).alias("name")).where("name <> ''")
    top = tokens.groupBy("name").count()
    top = top if width is None else top.orderBy(F.desc("count"), "name").limit(width)
    vocab_x = top.select((F.row_number().over(Window.orderBy(F.desc("count"), "name")) - 1).cast("int").alias("item"), "name").persist()
    # width rows are sent to every task, all tokens are not
    x = tokens.join(vocab_x if width is None else F.broadcast(vocab_x), "name").select("rid", "item").persist(StorageLevel.MEMORY_AND_DISK)
    names = table.where("lang IS NOT NULL").select(F.col("doc_id").alias("rid"), F.concat(F.lit("lang="), "lang").alias("name"))
    for column in ("quality", "toxic"):
        names = names.unionByName(marks.where(F.col(column).isNotNull()).select(F.col("doc_id").alias("rid"), F.concat(F.lit(f"{column}="), F.col(column).cast("string")).alias("name")))
    vocab_y = numbered(names.select("name").distinct()).persist()
    y = names.join(vocab_y, "name").select("rid", "item").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    rows = table.select(F.col("doc_id").alias("rid"))
    return Dataset(x, y, rows, vocab_x, vocab_y, rows.count())


def hash_split(rows: DataFrame, share: float, seed: int = 1234) -> DataFrame:
    """``rid, split``: train with probability ``share`` by a hash of the row, else test; the parts are disjoint and complete."""
    from ruleloom.functions.scalar import uniform

    return rows.select("rid", F.when(uniform(F.lit(seed), F.col("rid")) < share, "train").otherwise("test").alias("split"))


def quantile_cells(table: DataFrame, rid: str, columns: list[str], share: float, strict: bool = False) -> DataFrame:
    """Cells ``(rid, name)`` of the values above the column's exact quantile (``strict``: at or above it), all columns in one pass."""
    from ruleloom.operators.evaluation import quantiles

    values = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = table.select(F.col(rid).alias("rid"), values.alias("x")).select("rid", "x.name", "x.v")
    cuts = quantiles(long, ["name"], "v", [share]).toDF("name", "cut")
    # one row per column
    return long.join(F.broadcast(cuts), "name").where("v >= cut" if strict else "v > cut").select("rid", "name")


def category_cells(table: DataFrame, rid: str, columns: list[str]) -> DataFrame:
    """Cells ``(rid, 'column=value')`` of nominal columns; nulls give no cell."""
    pairs = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("name")) for c in columns)))
    return table.select(F.col(rid).alias("rid"), pairs.alias("v")).where("v.name IS NOT NULL").select("rid", "v.name").distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV file as ``rid, c0, c1, ...``: a row number by place, typed columns, blanks as nulls."""
    table = spark.read.csv(path, header=False, inferSchema=True)
    return table.toDF(*(f"c{i}" for i in range(len(table.columns)))).select(F.monotonically_increasing_id().alias("rid"), "*")


def csv_cells(table: DataFrame, rid: str, labels_below: int = 3, features_below: int = 15) -> tuple[DataFrame, DataFrame]:
    """Features and labels of an untyped table by numbers of distinct values: few are labels, some are features, many are dropped."""
    columns = [c for c in table.columns if c != rid]
    counts = table.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return tuple(category_cells(table, rid, own) if own else table.select(F.col(rid).alias("rid"), F.lit("").alias("name")).limit(0) for own in (
        [c for c in columns if labels_below <= counts[c] < features_below], [c for c in columns if counts[c] < labels_below]))


def synthetic_rules(spark: SparkSession, n: int, rules: list[tuple[list[int], list[int]]], noise: float = 0.0, seed: int = 1, overlap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows covered by planted rules, with cells flipped at the rate ``noise``: ``x, y`` cells.

    A row takes each rule by its own hash; without ``overlap`` it takes one rule only.
    """
    from ruleloom.functions.scalar import uniform

    rows = spark.range(n).toDF("rid")
    planted = spark.createDataFrame([(k, h, t) for k, (h, t) in enumerate(rules)], "k int, head array<int>, tail array<int>")
    taken = uniform(F.lit(seed), F.lit("r"), F.col("rid"), F.col("k")) < 0.5 if overlap else F.floor(uniform(F.lit(seed), F.lit("r"), F.col("rid")) * len(rules)) == F.col("k")
    # the planted rules are a parameter
    covered = rows.crossJoin(F.broadcast(planted)).where(taken)
    out = []
    for side, column in (("x", "head"), ("y", "tail")):
        top = max(i for r in rules for i in r[column == "tail"]) + 1
        ones = covered.select("rid", F.explode(column).alias("item")).distinct().withColumn("one", F.lit(True))
        flips = rows.select("rid", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("item")).where(uniform(F.lit(seed), F.lit(side), F.col("rid"), F.col("item")) < noise).withColumn("flip", F.lit(True))
        out.append(ones.join(flips, ["rid", "item"], "full").where(F.coalesce("one", F.lit(False)) != F.coalesce("flip", F.lit(False))).select("rid", "item"))
    return out[0], out[1]


def random_multilabel(spark: SparkSession, n: int, n_features: int, n_labels: int, labels_per_row: float, density: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Random rows whose features go with their labels: ``x, y`` cells.

    A label is there with probability ``labels_per_row / n_labels``. A feature's value is its affinity, 0 to 9, to each label of the row, and a
    noise of 0 to 9; it is a one above the feature's quantile ``1 - density``.
    """
    from ruleloom.functions.scalar import uniform
    from ruleloom.operators.evaluation import quantiles

    def ten(*key) -> Column:
        return F.floor(uniform(F.lit(seed), *key) * 10).cast("int")

    rows = spark.range(n).toDF("rid")
    # sizes of parameters
    y = rows.select("rid", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))).alias("item")).where(uniform(F.lit(seed), F.lit("y"), F.col("rid"), F.col("item")) < labels_per_row / n_labels)
    cells = rows.select("rid", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("item"))
    own = cells.join(y.select("rid", F.col("item").alias("label")), "rid").groupBy("rid", "item").agg(F.sum(ten(F.lit("a"), F.col("label"), F.col("item"))).alias("s"))
    values = cells.join(own, ["rid", "item"], "left").select("rid", "item", (F.coalesce("s", F.lit(0)) + ten(F.lit("x"), F.col("rid"), F.col("item"))).alias("v"))
    cuts = quantiles(values, ["item"], "v", [1 - density]).toDF("item", "cut")
    return values.join(F.broadcast(cuts), "item").where("v > cut").select("rid", "item"), y


def split_dataset(whole: Dataset, share: float, seed: int = 1234) -> tuple[Dataset, Dataset]:
    """Train and test parts by ``hash_split``, with the same vocabularies."""
    parts = []
    for name in ("train", "test"):
        rows = hash_split(whole.rows, share, seed).where(F.col("split") == name).select("rid")
        parts.append(Dataset(whole.x.join(rows, "rid", "left_semi"), whole.y.join(rows, "rid", "left_semi"), rows, whole.vocab_x, whole.vocab_y, rows.count()))
    return parts[0], parts[1]


def label_frequency(data: Dataset) -> DataFrame:
    """``item, freq`` of every label, unused ones too."""
    own = data.y.groupBy("item").agg(F.count("*").alias("freq"))
    return data.vocab_y.select("item").join(own, "item", "left").fillna(0, ["freq"])


def load(spark: SparkSession, name: str, folder: str | None = None, labels: int | str | None = None, sparse: bool = False, share: float = 0.7) -> tuple[Dataset, Dataset]:
    """Train and test data by name: ``toy`` (test is train), ``docs`` from the driver's tables in ``folder``, or the ARFF files of the name below
    ``folder``, whose labels are the last ``labels`` attributes or those an XML file names."""
    if name == "toy":
        return toy(spark), toy(spark)
    if folder is None:
        raise ValueError(f"no folder for {name}")
    if name == "docs":
        return split_dataset(docs(spark, folder), share)
    from ruleloom.sources.arff import read_directory

    return read_directory(spark, f"{folder}/{name}", labels, sparse, share)
