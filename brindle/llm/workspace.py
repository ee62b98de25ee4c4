"""Shared-folder helpers: intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session does not set it and runs on one machine (tests) a
    temporary folder is made, and removed when the process ends.  Elsewhere
    executors would not see each other's files: ValueError.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^-]*\])?$", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Workspace:
    """A fresh folder under the shared root for one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/brindle/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
        #: By table: what was counted while it was written.
        self.told: dict[str, dict] = {}

    def save(self, df: DataFrame, name: str, compression: str = "zstd", **told: Column) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back: lineage is cut.

        Its number of ``rows``, and other aggregates that the caller names, are
        taken as it is written, without a job of their own; see ``told``.
        """
        where = f"{self.path}/{name}"
        schema = df.schema
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in told.items()]).write.option("compression", compression).mode("overwrite").parquet(where)
        self.told[name] = seen.get
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, f"{self.path}/{name}")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, whose results must have been written by then."""
    _delete(spark, f"{shared_root(spark)}/brindle/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it ends, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sent(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows at most, else as it is; ``rows``: how many it has, where that is known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], rows: str, *, how: str = "inner", hot: int = 1000) -> DataFrame:
    """``left`` with the columns of its key's row in ``right`` (but ``rows``), null keys as keys too.

    right: a row for each key; ``rows`` says how many rows of ``left`` have it.
    Keys of more than 1/``hot`` of all rows, fewer than ``hot`` of them, are
    broadcast, the others shuffle: no task gets a hot key.  how: inner or left.
    right is read several times: a stored table.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    named = right.select(*[F.col(k).alias(f"__key_{k}") for k in keys], rows, *[c for c in right.columns if c not in (*keys, rows)])
    many = F.col(rows) * hot > total
    frequent, rest = named.filter(many).drop(rows), named.filter(~many).drop(rows)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    drop = [f"__key_{k}" for k in keys]
    ours = left.join(F.broadcast(frequent), same)
    theirs = left.join(F.broadcast(frequent.select(*drop)), same, "left_anti").join(rest, same, how)
    return ours.unionByName(theirs).drop(*drop)
