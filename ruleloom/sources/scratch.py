"""Tables in the shared scratch folder that the cluster names: they end a lineage in files any executor can read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set a temporary one on a local master, else ``RuntimeError``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="ruleloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _remove(path: str) -> None:
    spark = _LIVE.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_LIVE):
        _remove(path)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back; the table goes with ``release`` or when the interpreter ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ruleloom/{uuid.uuid4().hex}"
    _LIVE[path] = spark
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def mark() -> set[str]:
    """The tables there are now, for ``release_since``."""
    return set(_LIVE)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and nothing needs any more."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            _remove(path)


def release_since(before: set[str], *keep: DataFrame) -> None:
    """Delete every table made since ``mark`` but those in ``keep``."""
    spared = before | {getattr(t, "_scratch_path", None) for t in keep}
    for path in [p for p in _LIVE if p not in spared]:
        _remove(path)
