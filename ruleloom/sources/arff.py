"""ARFF text files, dense and sparse, as cells ``(rid, item)``; labels are the last attributes, or those that an XML file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.sources.relations import Dataset, dataset, quantile_cells, split_dataset


def _lines(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], DataFrame]:
    """Attributes (name, type), and data lines with a row number by place. The header is small and read by the driver."""
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    text = text.where("line <> '' AND NOT line LIKE '#%' AND NOT line LIKE '!%%' ESCAPE '!'")
    start = text.where(F.lower("line").startswith("@data")).agg(F.min("at")).first()[0]
    if start is None:
        raise ValueError(f"{path} has no data section")
    head = text.where((F.col("at") < start) & F.lower("line").startswith("@attribute")).orderBy("at").collect()
    attributes = []
    for row in head:
        rest = row["line"].split(None, 1)[1]
        if rest[0] in "'\"":
            end = rest.index(rest[0], 1)
            attributes.append((rest[1:end], rest[end + 1 :].strip()))
        else:
            name, kind = rest.split(None, 1)
            attributes.append((name, kind.strip()))
    return attributes, text.where(F.col("at") > start).select(F.col("at").alias("rid"), "line")


def label_names(spark: SparkSession, path: str) -> set[str]:
    """The ``name`` of every ``label`` element of an XML file, a small list read by the driver."""
    import xml.etree.ElementTree as Tree

    whole = spark.read.text(path, wholetext=True).first()
    if whole is None:
        raise ValueError(f"{path} is empty")
    return {e.get("name") for e in Tree.fromstring(whole[0]).iter() if e.tag.rsplit("}", 1)[-1] == "label"}


def _split(attributes: list[tuple[str, str]], labels: int | set[str]) -> set[int]:
    """Places of the label attributes."""
    if isinstance(labels, int):
        return set(range(len(attributes) - labels, len(attributes)))
    found = {i for i, (name, _) in enumerate(attributes) if name in labels}
    if len(found) < len(labels):
        raise ValueError("labels that are no attributes: " + ", ".join(sorted(labels - {a for a, _ in attributes})))
    return found


def read_sparse(spark: SparkSession, path: str, labels: int | set[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """``{i v, j v}`` lines: every listed index is a one whatever its value; ``x, y, names``. Features and labels are numbered from 0 in file order."""
    attributes, data = _lines(spark, path)
    own = _split(attributes, labels)
    entry = F.explode(F.regexp_extract_all("line", F.lit(r"[{,]\s*([0-9]+)\s"), F.lit(1)))
    cells = data.select("rid", entry.alias("i")).select("rid", F.col("i").cast("int").alias("at")).distinct()
    numbers, places = [], {True: 0, False: 0}
    for i in range(len(attributes)):
        numbers.append((i, i in own, places[i in own]))
        places[i in own] += 1
    # one row per attribute
    numbered = cells.join(F.broadcast(spark.createDataFrame(numbers, "at int, label boolean, item int")), "at")
    return numbered.where("NOT label").select("rid", "item"), numbered.where("label").select("rid", "item"), [a for a, _ in attributes]


def _cells(table: DataFrame, attributes: list[tuple[str, str]], which: list[int], labels: set[int], share: float, strict: bool) -> DataFrame:
    fixed, numeric = [], []
    for i in which:
        name, kind = attributes[i]
        options = [v.strip().strip("'\"") for v in kind.strip("{}").split(",")] if kind.startswith("{") else []
        plain = F.regexp_replace(f"c{i}", "['\"]", "")
        if len(options) > 2:
            fixed.append((F.concat(F.lit(f"{name}="), plain), F.lit(True)))
        elif options or i in labels:
            fixed.append((F.lit(name), F.upper(plain).isin("1", "YES", "TRUE", "1.0")))
        else:
            numeric.append((i, name))
    out = table.select("rid", F.lit("").alias("name")).limit(0)
    if fixed:
        pairs = F.explode(F.array(*(F.struct(n.alias("name"), o.alias("one")) for n, o in fixed)))
        out = out.unionByName(table.select("rid", pairs.alias("v")).where("v.one").select("rid", "v.name"))
    if numeric:
        numbers = table.select("rid", *(F.col(f"c{i}").cast("double").alias(f"c{i}") for i, _ in numeric))
        named = spark_names(table.sparkSession, numeric)
        found = quantile_cells(numbers, "rid", [f"c{i}" for i, _ in numeric], share, strict).withColumnRenamed("name", "column")
        out = out.unionByName(found.join(F.broadcast(named), "column").select("rid", "name"))
    return out


def spark_names(spark: SparkSession, numeric: list[tuple[int, str]]) -> DataFrame:
    """``column, name``: a row per attribute."""
    return spark.createDataFrame([(f"c{i}", name) for i, name in numeric], "column string, name string")


def read_dense(spark: SparkSession, path: str, labels: int | set[str], share: float = 0.5, strict: bool = False, drop_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Comma-separated lines as cells ``(rid, name)``.

    A blank is 0. Numeric attributes are ones above their exact quantile ``share`` (``strict``: at or above it), all found in one pass; nominal ones of
    more than two values become ``name=value``, of two values ones for 1 or YES. ``drop_first`` leaves the first attribute out.
    """
    attributes, data = _lines(spark, path)
    own = _split(attributes, labels)
    parts = F.split("line", ",")
    value = [F.trim(F.try_element_at(parts, F.lit(i + 1))) for i in range(len(attributes))]
    table = data.select("rid", *(F.coalesce(F.when(v == "", "0").otherwise(v), F.lit("0")).alias(f"c{i}") for i, v in enumerate(value)))
    features = [i for i in range(int(drop_first), len(attributes)) if i not in own]
    return _cells(table, attributes, features, own, share, strict), _cells(table, attributes, sorted(own), own, share, strict)


def read_genbase(spark: SparkSession, path: str, labels: int | set[str], share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Dense lines whose first attribute is a key: it goes, and numbers at their quantile are ones too."""
    return read_dense(spark, path, labels, share, strict=True, drop_first=True)


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isFile())


def read_directory(spark: SparkSession, folder: str, labels: int | str | set[str] | None = None, sparse: bool = False, share: float = 0.7, quantile: float = 0.5) -> tuple[Dataset, Dataset]:
    """Train and test data of a folder ``name``: ``name-train.arff`` and ``name-test.arff`` where a file has "train" in its name, else
    ``name.arff`` split at random with ``share`` of the rows in train.

    ``labels`` is their number at the end, their names, or a path to an XML file with them; without it the folder's ``name.xml`` is read.
    A folder called genbase has keys in front. Both parts share the vocabularies of all rows.
    """
    name, files = folder.rstrip("/").rsplit("/", 1)[-1], files_in(spark, folder)
    if labels is None or isinstance(labels, str):
        labels = label_names(spark, labels or f"{folder}/{name}.xml")

    def cells(file: str) -> tuple[DataFrame, DataFrame]:
        path = f"{folder}/{file}"
        if not sparse:
            return (read_genbase if name == "genbase" else read_dense)(spark, path, labels, quantile)
        x, y, names = read_sparse(spark, path, labels)
        own = _split([(n, "") for n in names], labels)
        sides = [[n for i, n in enumerate(names) if (i in own) == label] for label in (False, True)]
        named = [spark.createDataFrame(list(enumerate(side)), "item int, name string") for side in sides]
        return tuple(c.join(F.broadcast(v), "item").select("rid", "name") for c, v in zip((x, y), named, strict=True))

    def rows(file: str) -> DataFrame:
        return _lines(spark, f"{folder}/{file}")[1].select("rid")

    if not any("train" in f for f in files):
        file = f"{name}.arff"
        return split_dataset(dataset(*cells(file), rows(file)), share)
    parts = {part: f"{name}-{part}.arff" for part in ("train", "test")}
    x, y, every = None, None, None
    for place, file in enumerate(parts.values()):
        # even row numbers are train rows, odd ones test rows
        moved = [c.withColumn("rid", F.col("rid") * 2 + place) for c in (*cells(file), rows(file))]
        x, y, every = moved if x is None else [a.unionByName(b) for a, b in zip((x, y, every), moved, strict=True)]
    whole = dataset(x, y, every)
    out = []
    for place in range(2):
        own = F.col("rid") % 2 == place
        mine = whole.rows.where(own)
        out.append(Dataset(whole.x.where(own), whole.y.where(own), mine, whole.vocab_x, whole.vocab_y, mine.count()))
    return out[0], out[1]
