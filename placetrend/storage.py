"""The shared scratch folder, tables written between stages, and results that replace earlier ones."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="placetrend-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may go without the setting; it then gets its own.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    return _local_folder()


#: Scratch paths that this process has given out.
_given: list[str] = []
#: Of these, the tables that the catalog knows by a name.
_tables: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    path = f"{shared_folder(spark)}/placetrend/{label}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


@contextmanager
def scratch_of_a_job(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after a failure, what was written below the shared folder within it."""
    before = len(_given)
    try:
        yield
    finally:
        while len(_given) > before:
            path = _given.pop()
            if table := _tables.pop(path, None):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(spark, path)


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of ``path``, whatever store it is in, and the path with its scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def delete(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def replace_with(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[], None] | None = None) -> None:
    """Runs ``write`` on a folder beside ``path`` and then puts that folder in its place.

    An earlier result may be read while the new one is computed, even by ``write`` itself. It stays if
    ``write`` or ``check``, which is called next, fails; the half-written folder goes. Folders in
    between have names that begin with an underscore, which no reader of the parent folder picks up.
    The swap is two renames: where a store copies on renaming it takes as long as that, and a driver
    lost between the two leaves the earlier result under its name with ``-before``.
    """
    system, target = file_system(spark, path)
    mark = uuid.uuid4().hex
    name, parent = target.getName(), target.getParent()
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(parent, f"_{name}-{mark}-{x}") for x in ("next", "before"))
    try:
        write(new.toString())
        if check is not None:
            check()
    except BaseException:
        system.delete(new, True)
        raise
    had = system.exists(target)
    if had and not system.rename(target, old):
        raise OSError(f"{path} could not be moved away; the new result is in {new}")
    if not system.rename(new, target):
        if had:
            system.rename(old, target)
        raise OSError(f"{new} could not be moved to {path}")
    if had:
        system.delete(old, True)


def replace_partitions(writer: DataFrameWriter, path: str, save: Callable[[DataFrameWriter, str], None]) -> None:
    """Writes a partitioned table so that partitions it has rows for replace those of an earlier run;
    others stay, and all stay if it fails."""
    save(writer.mode("overwrite").option("partitionOverwriteMode", "dynamic"), path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many times: for a table that several branches of a job read.

    The copy is plain parquet in shared storage, so it outlives any executor and lets each
    reader prune columns for itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str, write_first: bool) -> DataFrame:
    """``df`` written once if asked, for statistics that a job passes over several times.

    Global statistics, a sort's sample and the result each read their input anew. The input here
    has one row per locality, while what it is computed from has one per locality and year.
    """
    return materialise(df, label) if write_first else df


def stored_by_key(df: DataFrame, label: str, key: str, *order: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in buckets of ``key``, one file each, sorted in it by ``key`` and ``order``.

    What is then grouped, windowed or stacked by ``key``, however often and in however many jobs, needs no
    exchange, if all tables have the same number of ``buckets``; it is the number of shuffle partitions
    unless given, so a bucket is one task's work. The rows are shuffled once, for the write; a key of very
    many rows is one bucket's, so store panels, which have a row per key and year, not raw rows.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    table = f"placetrend_{path.rpartition('-')[2]}"
    dealt = df.repartition(n, key).sortWithinPartitions(key, *order)
    dealt.write.option("path", path).bucketBy(n, key).sortBy(key, *order).saveAsTable(table)
    _tables[path] = table
    return spark.table(table)
