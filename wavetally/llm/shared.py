"""Folders that driver and executors share, tables written there to cut lineage, and columns added by Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
#: Attribute of a table from :func:`written` that holds its folder.
_PATH = "_written_at"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster must
    have it, as no other folder is sure to be shared by driver and executors.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def frugal(run: Callable) -> Callable:
    """A function over batches that gives a task's memory back when it ends: workers are used again for other operators."""

    @wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators do."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position, so that they clash with nothing, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def added(df: DataFrame, text: str, make: Callable[[Iterable[list]], Iterator[tuple]], columns: str, carry: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``carry``, or all) with the ``columns`` that ``make`` gives for its texts.

    ``make`` takes an iterator over lists of texts (None for null), one list for each
    batch, and yields as many tuples of values, one for each new column. The columns that are carried
    stay Arrow data from end to end: no value of theirs, such as an id, takes another type on its way.
    """
    carry = df.columns if carry is None else carry
    more = StructType.fromDDL(columns)
    schema = StructType([df.schema[c] for c in carry] + list(more.fields))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in more.fields]
        waiting: list = []

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield batch.column(batch.schema.get_field_index(text)).to_pylist()

        for values in make(texts()):
            batch = waiting.pop(0)
            new = [pa.array(v, t) for v, t in zip(values, types)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carry] + new, names=schema.names)

    return df.mapInArrow(frugal(run), schema)


def kept(df: DataFrame, text: str, test: Callable[[Iterable[list]], Iterator[list]]) -> DataFrame:
    """The rows of ``df`` whose texts pass: ``test`` takes an iterator over lists of texts and yields lists of booleans."""

    def run(batches):
        import pyarrow as pa

        waiting: list = []

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield batch.column(batch.schema.get_field_index(text)).to_pylist()

        for passed in test(texts()):
            yield waiting.pop(0).filter(pa.array(passed, pa.bool_()))

    return df.mapInArrow(frugal(run), df.schema)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written as Parquet in a shared folder and read again: its plan starts at that table."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(got, _PATH, path)
    return got


def discard(*tables: DataFrame | None) -> None:
    """Delete tables from :func:`written` that nothing reads any more: all that came of them must be written itself."""
    for t in tables:
        path = getattr(t, _PATH, None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
