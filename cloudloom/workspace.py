"""Where intermediate tables go, and how lineage is cut.

Everything written here goes to the folder that the session names in
``spark.checkpoint.dir``, which driver and executors share, so a lost executor
costs at most a task's rerun and never a lost intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cloudloom-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    for made in _scopes:
        made.append(table)
    return table


def materialise_counting(df: DataFrame, label: str, condition: str = "true") -> tuple[DataFrame, int]:
    """``materialise``, and how many rows meet a condition, seen by the pass that writes them."""
    seen = Observation()
    count = F.count(F.when(F.expr(condition), 1))
    table = materialise(df.observe(seen, count.alias("n")), label)
    return table, seen.get.get("n") or 0


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote, once nothing will read them; other DataFrames and None are left alone."""
    for table in tables:
        path = _paths.pop(table, None) if table is not None else None
        if path:
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def superseded() -> Iterator[list[DataFrame]]:
    """Deletes at the end all tables written inside, but those put on the list that it gives; and none after an error."""
    made: list[DataFrame] = []
    keep: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
    release(*[t for t in made if not any(t is k for k in keep)])


def partitions_for(spark: SparkSession, rows: float, rows_a_task: float) -> int:
    """How many shuffle partitions keep each task under ``rows_a_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // rows_a_task) + 1)
