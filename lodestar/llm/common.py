"""Helpers shared by the corpus operators: shared tables, Arrow column functions, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of code points other than these six; Java and Python patterns agree on it.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"


_own_dir: list[str] = []
_tables: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session has a folder of its own until the process ends; on a cluster this is an error,
    because the parts of a table in a local folder would lie on different machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lodestar-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    _tables[path] = None
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _tables.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestar_path", None)
    if path:
        _delete(df.sparkSession, path)


def stored_tables() -> set[str]:
    """Folders of the tables that this process stored and nothing has deleted."""
    return set(_tables)


def cleanup(spark: SparkSession, but: Iterable[str | DataFrame] = ()) -> None:
    """Delete all tables that stored() wrote but these (folders, or tables as stored() returned them).

    For when the results that read them have been read themselves: an operator's result is lazy and may need them.
    """
    left = {getattr(b, "_lodestar_path", b) for b in but}
    for path in stored_tables() - left:
        _delete(spark, path)


def with_arrow(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], most: int = 8 << 20) -> DataFrame:
    """Append (or replace) columns computed per Arrow batch, keeping all other columns.

    make() runs once in each task and returns the function from a batch to one array per field. Batches come in
    slices of about `most` bytes.
    """
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in pieces(batch, most):
                made = compute(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + made, names=kept + names)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes, so that very long texts don't pile up."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use reads it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def fold_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the split between learning and held-out rows."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def n_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
