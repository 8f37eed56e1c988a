"""Session settings shared by every query: checkpoint folder, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str, str]] = []
_CLEANED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, lazily."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``table`` for work that is heavy per row: one of too few splits for the cluster's cores is dealt out by ``key``.

    A large table has splits enough, by the number or the size of its files, and is left as it is, so nothing is shuffled.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    where = _places(df)
    enough = sum(len(x.inputFiles()) for x in where) >= cores or sum(x.sizeInBytes() for x in where) >= split * cores
    return df if enough else df.repartition(cores, key)


def _leaves(df: DataFrame) -> list:
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return [leaves.apply(k) for k in range(leaves.size())]


def _places(df: DataFrame) -> list:
    """Where the tables of files lie that ``df`` is read from, as Spark's planner knows them."""
    return [x.relation().location() for x in _leaves(df) if x.getClass().getSimpleName() == "LogicalRelation" and hasattr(x.relation(), "location")]


def stamp_of(df: DataFrame) -> str:
    """Tells what ``df`` is: its plan, and the folders or files that it is read from with their size and time of change."""
    spark, told = df.sparkSession, [x.getClass().getSimpleName() for x in _leaves(df)]
    for where in _places(df):
        for i in range(where.rootPaths().size()):
            path = where.rootPaths().apply(i)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            told.append((path.toString(), status.getModificationTime(), status.getLen()))
        told.append(where.sizeInBytes())
    return md5(repr((told, df._jdf.queryExecution().analyzed().canonicalized().semanticHash())).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own; any
    other master is refused, as a folder of one machine is lost with it.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        own = context.getCheckpointDir().get()
        if own not in _CLEANED:  # it is this session's alone, below the folder that was set
            _CLEANED.add(own)
            atexit.register(_delete, spark, own)
        return own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glosswork-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return checkpoint_folder(spark)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder then stays
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage.

    The copy outlives a lost executor, unlike a local checkpoint.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; what is put there goes with ``release`` or when the program ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, kind, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table: columns that repeat take little space, and later reads take only what they need."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(kind: str | None = None) -> None:
    """Deletes the folders of ``new_folder``, all or those of one ``kind`` (``table`` for those of ``written``).

    For sessions that run many queries; results that are not read yet must not need the folders any more.
    """
    for entry in [x for x in _WRITTEN if kind in (None, x[1])]:
        _WRITTEN.remove(entry)
        _delete(entry[0], entry[2])
