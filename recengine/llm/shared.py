"""Tables and files that a query writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset, as in tests, a folder of this machine."""
    global _OWN
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        _OWN = _OWN or "file://" + tempfile.mkdtemp(prefix="recengine-")
    return (named or _OWN).rstrip("/")


#: Rows of a few numbers that one task writes.
ROWS = 250_000


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and written as Parquet to the shared folder; what follows reads it from there.

    A lost executor then costs its tasks only, the plan behind ``df`` is cut off, and Spark knows the table's size, by which
    it may broadcast a small one. ``rows``, if it is known that there are no more, says how many tasks are worth it: a small
    table is not dealt over as many files as a large one. The tables are the session's: who clears the shared folder clears them.
    """
    path = f"{folder(df.sparkSession)}/recengine/{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(source: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``source.mapInArrow(task, schema)``, kept: the Python workers write the Parquet files themselves, so rows do not go back through the
    executor. A task that runs again writes the same file under the same name, which it has only when it is whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = source.sparkSession
    where, target = f"{folder(spark)}/recengine/{uuid.uuid4().hex}", to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet
        from pyspark import TaskContext

        fs, base = store(where)
        writer, sink, opened, held, size = None, None, f"{base}/_{uuid.uuid4().hex}", [], 0

        def flush() -> None:
            nonlocal writer, sink, held, size
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(opened)
                writer = parquet.ParquetWriter(sink, target, compression="zstd", use_dictionary=False)
            writer.write_table(pa.Table.from_batches(held, target))
            held, size = [], 0

        for batch in task(batches):
            if batch.num_rows:
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(batch.columns, target, strict=True)]
                held.append(pa.RecordBatch.from_arrays(arrays, schema=target))
                size += batch.nbytes
                if size > 8 << 20:
                    flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(opened, f"{base}/part-{TaskContext.get().partitionId():07d}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["files"])

    if not source.mapInArrow(run, "files long").count():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(where)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI, for files that workers read and write themselves."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(where: str, raw: bytes) -> None:
    """Writes a file, which has its name only when it is whole: a task that runs again, or twice, does no harm."""
    fs, path = store(where)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(opened := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(raw)
    fs.move(opened, path)


def get(where: str) -> bytes:
    fs, path = store(where)
    with fs.open_input_file(path) as f:
        return f.read()


#: Rows of ids that may be broadcast: some 20 MB. What may be longer is counted first, and joined by shuffle beyond this.
FEW = 1_000_000


def bounded(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """A kept table of a few numbers a row: marked for broadcast if it has at most FEW rows. ``rows``: a bound that is known already."""
    return F.broadcast(ids) if (ids.count() if rows is None else rows) <= FEW else ids


_OWN = ""
