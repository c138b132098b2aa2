"""Helpers that the training-data operators share.

Rows travel as Arrow batches (``mapInArrow``); every operator picks the columns
it needs by name, so extra or clashing columns of the input never reach it.
Intermediate results that must be read more than once are written as Parquet
below ``spark.checkpoint.dir``: a lost executor loses none of them.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text in one Arrow batch; it is held several times over, in the JVM's buffers, in the stream and as Python strings.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evalmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[tuple[object, str]] = []


def _clean() -> None:
    for sc, path in _made:
        try:
            remove(sc, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


atexit.register(_clean)


def remove(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/evalmill/{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext, path))
    return path


def scratch(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: the lineage ends there.

    With ``by``, rows of each value of that column lie in a folder of their own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.em_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``scratch`` wrote, once nothing reads it any more."""
    remove(df.sparkSession.sparkContext, df.em_path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns (lists or arrays)."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on for later tasks

    return df.mapInArrow(run, struct)


def append_columns(df: DataFrame, inputs: list[str], fn: Callable[..., dict], fields: T.StructType) -> DataFrame:
    """All columns of ``df`` and those that ``fn(*lists of the input columns)`` computes, with no shuffle.

    A column of ``df`` with the name of a new one gives way to it, as in ``withColumn``.
    """
    made = {f.name.lower() for f in fields}
    held = [i for i, c in enumerate(df.columns) if c.lower() not in made]
    struct = T.StructType([df.schema.fields[i] for i in held] + fields.fields)
    arrow = to_arrow_schema(struct)
    new = to_arrow_schema(fields)
    at = [df.columns.index(c) for c in inputs]

    def run(batches):
        for batch in batches:
            made = fn(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(arrow.field(k).type) for k, i in enumerate(held)] + [pa.array(made[f.name], type=f.type) for f in new], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, struct)


def crc_mod(col, n: int):
    """The fold of a row: crc32 of the id's text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n)), F.lit(0)) if isinstance(col, str) else F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n)), F.lit(0))


#: Rows of a side that may be broadcast: a key and a few numbers each, at most about 16 MB.
BROADCAST_ROWS = 100_000


def joined_by_key(rows: DataFrame, side: DataFrame, key: str, n: str, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``side``, one row a key, whose ``n`` says how many rows have the key.

    The keys of more than ``hot`` rows, at most ``BROADCAST_ROWS`` of them and
    those of most rows, meet their rows by broadcast, so that no task gets all
    rows of one; any other key has at most a ``BROADCAST_ROWS``-th of all rows.
    """
    most = scratch(side.filter(F.col(n) > hot).orderBy(F.desc(n), key).limit(BROADCAST_ROWS), "hot")
    if most.isEmpty():
        return rows.join(side, key)
    keys = F.broadcast(most.select(key))
    return rows.join(F.broadcast(most), key).unionByName(rows.join(keys, key, "left_anti").join(side.join(keys, key, "left_anti"), key))
