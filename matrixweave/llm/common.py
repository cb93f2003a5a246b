"""What the operators of this subpackage share: the shared folder, written tables, components, text batches.

Rows are told apart by ``doc_id``; rows that repeat a doc_id are parts of one document
unless an operator says otherwise, and a null doc_id is a document of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder, as in tests.
_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="matrixweave-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{scratch_dir(spark)}/matrixweave/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: its lineage ends there, and lost executors cost nothing.

    The table goes when the application ends, or before that by ``unstash``.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    at, system = _located(df.sparkSession, path)
    system.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _located(spark: SparkSession, path: str):
    """The path and its file system, in the driver's JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def unstash(df: DataFrame | None) -> None:
    """Delete what ``stash`` wrote; only for tables that no plan still reads."""
    path = getattr(df, "_stashed_at", None)
    if path:
        at, system = _located(df.sparkSession, path)
        system.delete(at, True)


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _text): all columns of ``docs`` as one struct, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def released(df: DataFrame, docs: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``docs`` from ``carried`` rows, then the columns named; these replace ones of the same name."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in more], *[v.alias(k) for k, v in more.items()])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``; component is the smallest node reachable.

    Alternates large-star and small-star steps, which move every neighbour to the
    smallest one seen, until no edge changes.  The minima are pre-aggregated before
    the shuffle and joined back, so a node with very many neighbours is a skewed join
    that Spark splits, and each round ends in a written table.  Self-links and nulls
    are dropped: a node without a link to another has no row.
    """
    now = stash(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written apart from their joins, so that Spark can split a node of very many neighbours.
        low = stash(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "cc-large")
        unstash(low)
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        unstash(low)
        unstash(large)
        sign = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        unstash(now)
        now = after
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def pieces_of(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` in order, each of about ``most_bytes`` of text or one row."""
    text = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0))
    total = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Rows that are sent to a Python worker at a time; texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of texts, on both sides; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What drops each memory that a Python worker keeps between tasks, by its name.
_MEMORIES: dict[str, Callable[[], None]] = {}


def memory(name: str, clear: Callable[[], None]) -> None:
    """Make a memory known, so that ``claim`` can drop it."""
    _MEMORIES[name] = clear


def claim(*names: str) -> None:
    """Drop all memories of this worker but the ones named: it may have served other operators before."""
    for name, clear in _MEMORIES.items():
        if name not in names:
            clear()


def tidy() -> None:
    """Give what a task no longer uses back to the system; Python workers live on after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches in order, put together or cut to about ``most_bytes`` of text each: distinct words pay off over much text."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for part in pieces_of(batch, column, most_bytes):
            own = int(pc.sum(pc.fill_null(pc.binary_length(part.column(column)), 0)).as_py() or 0)
            if held and size + own > most_bytes:
                yield whole()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield whole()


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered texts: (code of each word, the distinct words, offsets by text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(text), ""))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, offsets


#: splitmix64's constants: fixed values.
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer of uint64 values."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside each text, from word hashes: (hashes, offsets by text)."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(offsets[:-1] - out[:-1], lengths) + np.arange(out[-1])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = mixed(total * _GOLDEN + words[at + k])
    return total, out
