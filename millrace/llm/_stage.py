"""Where corpus operators keep intermediate tables, and how their code reaches executors.

Tables go under the folder that the session names in ``spark.checkpoint.dir``.
Where it is unset a temporary folder is used, if the driver's machine runs all
tasks (tests, notebooks); on a cluster that is an error.  The tables of an
application are deleted when its driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20

_own_dir: list[tempfile.TemporaryDirectory] = []
_shipped: set[str] = set()
_used: set[str] = set()
_settled: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one for each application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder: executors can't write where the driver reads")
        if not _own_dir:
            _own_dir.append(tempfile.TemporaryDirectory(prefix="millrace-"))
            atexit.register(_own_dir[0].cleanup)
        return "file://" + _own_dir[0].name
    folder = f"{named.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the application's tables while its session still runs; a lost driver's stay for the folder's own clean-up."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as an expression, dots and backticks in it included."""
    return "`" + name.replace("`", "``") + "`"


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores before them while a column has them already."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _settled[table] = path
    return table


def discard(df: DataFrame) -> None:
    """Deletes a table that ``settle`` returned; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_settled.pop(df))
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # already running from an archive that was shipped
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    out = os.path.join(tempfile.mkdtemp(prefix="millrace-code-"), f"millrace_{uuid.uuid4().hex[:8]}.zip")
    with open(out, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for a step that turns a batch into dicts of columns.

    ``make`` runs once per task and returns the step, which may keep state.
    The step sees a batch in slices of about ``SLICE_BYTES``, so that what it
    unpacks stays small, and a task returns its memory when it ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                for columns in step(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in target], schema=target)
            del batch
        _give_back()

    # By position: mapInArrow can't look up names with dots or backticks.
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def _give_back() -> None:
    """Freed memory goes back to the system: idle workers share the executor's limit with busy ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
