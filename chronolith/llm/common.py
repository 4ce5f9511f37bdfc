"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word rule here: space and U+0009 to U+000D.
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
SPLIT_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (one machine, as
    in tests); on a cluster a ValueError, since executors could not read such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="chronolith-"))


_SCRATCH: list[list[DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet under scratch_dir() and read it back. Within with_scratch() the table is
    deleted at the end; else it stays for as long as its reader may need it, and discard() deletes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/chronolith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df (a table may be gone already), through the file system of its path."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def with_scratch():
    """Deletes the tables that were materialised within it; what was made of them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            discard(df)


def fold(column):
    """crc32(text of the id) mod 4; remainder 2 is held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4, F.lit(-1))


def held_out(column):
    return fold(column) == 2


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that is no longer used back to the system, so that a worker's peak isn't kept between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tool(name: str, key, build: Callable):
    """What build() gives, kept in the Python worker until a tool of another name or key is asked for: one at a time."""
    import sys

    held = sys.__dict__.setdefault("_chronolith_tool", {})
    if held.get("key") != (name, key):
        held.clear()
        release()
        held.update(value=build(), key=(name, key))
    return held["value"]


def cuts(texts: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(first, how many) of parts of texts of about limit bytes each, so that what is made of them at once is bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, end - at
        at = end


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Views of a batch's rows, by cuts() of a column; memory is given back after the last."""
    for cut in cuts(batch.column(column)):
        yield batch.slice(*cut)
    release()


def text_udf(name: str, key, build: Callable, run: Callable, kind: str):
    """An Arrow UDF: run(tool, texts) gives an Arrow array of kind for each Arrow array of texts. Only the text goes to
    Python and only the result comes back. It counts as nondeterministic so that no plan evaluates it twice."""

    @F.arrow_udf(kind)
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tool(name, key, build)
        for batch in batches:
            parts = [run(own, batch.slice(*cut)) for cut in cuts(batch)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else run(own, batch)
            del parts
            release()

    return of_text.asNondeterministic()


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def structs(kind: pa.DataType, rows: list) -> pa.Array:
    """An Arrow array of structs of kind from tuples."""
    columns = list(zip(*rows)) if rows else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind))


class Shared:
    """A broadcast with a number of its own, by which a worker knows what it has built from it. The value is pickled
    as functions are, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        return pickle.loads(self.held.value)
