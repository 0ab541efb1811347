"""Where intermediate tables go, and joins whose small side is size-checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
GROUP_ROWS = 1_000_000
TASK_ROWS = 500_000
LEAST_ROWS = 20_000
SALTS = 32
GRID_CELLS = 16
_local_folders: dict[str, str] = {}
_recorders: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below the folder the session names in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would not be visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _local_folders[app]
    return f"{root.rstrip('/')}/shearmark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning and gives
    the optimizer a true size for its broadcast decisions.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_path = path
    for made in _recorders:
        made.append(table)
    return table


@contextmanager
def recording() -> Iterator[list[DataFrame]]:
    """The tables settled inside the block, for a caller that discards them when their result has been written."""
    made: list[DataFrame] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def discard(tables: list[DataFrame]) -> None:
    """Delete the files of settled tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def null_safe(left: DataFrame, right: DataFrame, on: list[str]):
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def join_groups(df: DataFrame, groups: DataFrame, on: list[str], how: str = "inner",
                limit: int = BROADCAST_ROWS, rows: int | None = None, largest: int | None = None) -> DataFrame:
    """Join one settled row per group back to the many rows of the group (null keys match).

    ``groups`` is broadcast only after counting it, or where the caller has counted what bounds it (``rows``); past the
    limit both sides are salted, so a group holding much of the data spreads over SALTS tasks.  That join is a merge by
    hint: the optimizer knows the size of the compressed files only, not that of their rows times SALTS, and would
    send them through the driver to every executor.  Where the caller knows that no group of ``df`` has more than
    ``largest`` rows and these are few, nothing is salted.
    """
    names = {c: f"_g_{c}" for c in on}
    right = groups.withColumnsRenamed(names)
    keys = [F.col(c).eqNullSafe(F.col(g)) for c, g in names.items()]
    if (groups.count() if rows is None else rows) <= limit:
        right, cond, extra = F.broadcast(right), keys, []
    elif largest is not None and largest <= GROUP_ROWS:
        right, cond, extra = right.hint("merge"), keys, []
    else:
        rest = [c for c in df.columns if c not in on] or list(on)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.lit(SALTS)))
        right = right.withColumn("_gsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        right, cond, extra = right.hint("merge"), keys + [F.col("_salt") == F.col("_gsalt")], ["_salt", "_gsalt"]
    joined = cond[0]
    for c in cond[1:]:
        joined = joined & c
    return df.join(right, joined, how).drop(*names.values(), *extra)


def dealt(df: DataFrame, on: list[str], rows: int) -> DataFrame:
    """``df`` by hash of ``on`` over as many tasks as ``rows`` need, so that a task's groups do not grow with the input."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, -(-rows // TASK_ROWS), min(parts, -(-rows // LEAST_ROWS))), *on)


def grid_join(a: DataFrame, b: DataFrame, on: list[str], a_key: str, b_key: str, cells: int = GRID_CELLS) -> DataFrame:
    """Join where every row of a group meets every row of the other side, because that is the result.

    Both sides are cut by a hash of their own key, so one group is a grid of
    cells x cells independent tasks, each row being copied ``cells`` times.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    left = a.withColumn("_a", part(a_key)).withColumn("_b", every)
    right = b.withColumn("_b", part(b_key)).withColumn("_a", every)
    return left.join(right, [*on, "_a", "_b"]).drop("_a", "_b")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` settled, with a broadcast hint when its counted size allows it."""
    table = settle(df, "small")
    return F.broadcast(table) if table.count() <= limit else table


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows in the biggest group: decides between a plain and a spread evaluation."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"))
    return sizes.first()[0] or 0
