"""Helpers of the training-data operators: the shared folder, tables written to cut lineage, crc32 folds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where unset: a temporary one in local mode, the warehouse on a cluster."""
    conf = spark.sparkContext.getConf()
    set_ = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if conf.get("spark.master", "").startswith("local") and "cluster" not in conf.get("spark.master", ""):
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="fragmill-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_fragmill"
    return _OWN[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here, and lost executors only cost their own tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fragmill_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no lazy plan reads any more."""
    for t in tables:
        if path := getattr(t, "_fragmill_path", None):
            session = t.sparkSession
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def row_of(df: DataFrame) -> Column:
    """All columns in one struct: whatever their names, none clashes with a column made beside it."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks held-out rows.  A null id is in no fold and never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def trimming(run):
    """`run`, a function from batches to batches, that gives free memory back to the system when it ends.

    A worker lives on with the next tasks, beside a JVM that has its own share of the executor's memory.
    """

    def trimmed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return trimmed


#: Bytes of rows that a worker is handed at once: Spark's own bound of 64 MiB is held there several times over, as a batch,
#: as Python's texts and as results, and by the JVM beside it.  One row may be larger.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands workers at most `BATCH_BYTES` at once; a smaller setting stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """`run` over batches of bounded size, in workers that give free memory back when it ends."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(trimming(run), schema)


_IN_USE: list = []


def in_use(cache) -> None:
    """Names the cache of the operator at work; the one that was before is emptied, so a worker holds one at a time."""
    if not _IN_USE or _IN_USE[0] is not cache:
        for c in _IN_USE:
            c.clear()
        _IN_USE[:] = [cache]


#: Code points of text that a worker takes at once.
HELD = 1_500_000


def in_blocks(texts: list[str], most: int = HELD) -> Iterator[slice]:
    """Slices of at most `most` code points, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def per_text(docs: DataFrame, run: Callable[[list[str]], dict[str, list]], columns: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of `docs`: its `keep` columns, then `columns` (DDL) as `run` gives them for a list of texts.

    Null text is handed over as empty.  Workers hold one Arrow batch and the results of one block of texts.
    """
    rows = docs.select(*(docs[f"`{c}`"] for c in keep), text_or_empty(docs))
    schema = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for s in in_blocks(texts):
                out = run(texts[s])
                kept = [b.column(i).slice(s.start, s.stop - s.start) for i in range(len(keep))]
                made = [pa.array(out[f.name], type=f.type) for f in list(arrow)[len(keep) :]]
                yield pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(kept, arrow)] + made, schema=arrow)

    return mapped(rows, work, schema)
