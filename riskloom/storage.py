"""Shared storage for intermediate tables.

Results that must not change between two reads (row positions, neighbour lists) are written as
parquet to the folder the cluster names in ``spark.checkpoint.dir``. A written table survives the
loss of executors and, unlike a checkpointed RDD, keeps column pruning for the reads that follow.
Tables go when the ``scratch`` block that made them ends, or else when the driver's process ends. Bucketed
ones are external tables in the same folder, so nothing stays in the warehouse or its catalog.
"""

import atexit
import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: (name, path, catalog table or None) of what was made and not dropped yet.
_made: list[tuple[str, str, str | None]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: the checkpoint folder, in local mode else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Spark's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def _drop(spark: SparkSession, entries: list[tuple[str, str, str | None]]) -> None:
    for _, _, table in entries:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_paths(spark, [path for _, path, _ in entries])


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()):
    """Drop every intermediate table made inside the block when it ends, but for the names to keep.

    For work that ends in files: frames that leave the block may only read the kept tables.
    """
    start = len(_made)
    try:
        yield
    finally:
        inside = _made[start:]
        _made[start:] = [entry for entry in inside if entry[0] in keep]
        _drop(spark, [entry for entry in inside if entry[0] not in keep])


def drop_made(spark: SparkSession, entries: list[tuple[str, str, str | None]]) -> None:
    """Drop some of what ``made_since`` lists."""
    left = [entry for entry in entries if entry in _made]
    for entry in left:
        _made.remove(entry)
    _drop(spark, left)


def made_since(mark: int = 0) -> list[tuple[str, str, str | None]]:
    """What was made after the first ``mark`` tables and not dropped yet."""
    return _made[mark:]


@atexit.register
def _drop_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        with contextlib.suppress(Exception):  # the session may have gone with its cluster
            _drop(spark, _made)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, whose size the optimizer knows."""
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) or [[] for _ in fields]
    arrays = [
        pa.array(list(column), _ARROW[field.dataType.simpleString()])
        for column, field in zip(columns, fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, [field.name for field in fields]))


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    _made.append((name, path, None))
    return path


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int, sort: bool = False) -> DataFrame:
    """``df`` written bucketed by ``key``: joins and groups on it leave the rows where they are."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_root(df.sparkSession)}/riskloom/{table}"
    _made.append((name, path, table))
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    writer = writer.sortBy(key) if sort else writer
    writer.option("compression", "zstd").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
