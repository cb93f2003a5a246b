"""Suffix-array dedup: every byte in a string of ``length`` bytes that starts anywhere else goes.

The collection's Burrows-Wheeler order and common prefixes are built column by column:
each round inserts one symbol of every string, moves the strings to their new order by
a stable sort on it, and updates where each meets its neighbour's end.  Two things make
that scale:

* Anchors deal the texts.  The anchor of a ``length``-byte window is its ``grain``-byte
  part of smallest hash (the leftmost of equal ones), so equal windows have equal
  anchors at equal offsets.  Neighbouring windows with one anchor stay together as one
  string, and only strings whose anchor occurs twice go on.  Equal strings become one
  with a weight before they are shuffled.
* The strings of one anchor are a bucket.  They are aligned at their anchors, so a round
  inserts the same column of all, and suffixes of other columns, which can't share a
  window with them, need no place in the order: a round costs the number of strings.
  The columns lie in a sequential file outside memory and are read from last to first.

A bucket of more than ``most`` different strings is dealt again by longer anchors, and
again, up to anchors of ``length`` bytes, whose buckets hold one string each; so buckets
are bounded and no match is lost.

Null texts are empty and texts shorter than ``length`` lose nothing.  Rows that repeat a
doc_id are texts of their own: their equal strings count as repeats.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import claim, mixed, pieces_of, small_batches, stash, tidy, unstash

LENGTH, GRAIN, MOST = 400, 64, 1024
SEGMENT = 1 << 20
SLICE_BYTES, RUN_BYTES = 4 << 20, 1 << 20
BATCH_STRINGS = 16384
#: Bits of a packed value that hold a place; the others hold the hash. The base of the hashes: a fixed odd number.
PLACE_BITS = np.uint64(28)
BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def window_hashes(data: np.ndarray, grain: int) -> np.ndarray:
    """A 64-bit hash of each ``grain`` bytes of ``data``."""
    n = len(data)
    up, down = _powers(1 << max(1, n - 1).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mixed((total[grain:] - total[:-grain]) * down[: n - grain + 1])


def sliding_min(values: np.ndarray, wide: int) -> np.ndarray:
    span = 1
    while span * 2 <= wide:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = wide - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_runs(data: np.ndarray, bounds: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, ...]:
    """(text, start of its first window, windows, offset of the anchor, key) of each run of windows with one anchor."""
    out = []
    wide = length - grain + 1
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = np.repeat(bounds[1:], np.diff(bounds)) - length
    for a in range(0, len(data) - length + 1, SEGMENT):
        part = data[a : a + SEGMENT + length - 1]
        hashes = window_hashes(part, grain)
        places = np.arange(len(hashes), dtype=np.uint64)
        packed = (hashes >> PLACE_BITS << PLACE_BITS) | places
        anchor = (sliding_min(packed, wide) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        starts = np.flatnonzero(np.arange(a, a + len(anchor)) <= last[a : a + len(anchor)])
        if not len(starts):
            continue
        own = anchor[starts]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(own) != 0))))
        count = np.diff(np.append(first, len(starts)))
        at = starts[first]
        text = text_of[a + at]
        out.append((text, a + at - bounds[text], count, own[first] - at, hashes[own[first]].view(np.int64)))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 5


def repeated_windows(strings: list[bytes], anchors: np.ndarray, buckets: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Ranges (first, past) of windows that another string of the same bucket holds too, for each string.

    ``buckets`` are ascending numbers; ``anchors`` are the anchors' offsets.  Column by
    column from the right, the order of all suffixes that start there, and the column
    at which each suffix parts from the one before it, follow from those of the column
    to the right by the symbols inserted.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    zero = int(anchors.max())
    left = zero - anchors
    wide = int((left + sizes).max())
    with tempfile.TemporaryFile() as file:
        # Columns of symbols, one after another: 0 where a string has none, else the byte plus one.
        flat = np.frombuffer(b"".join(strings), np.uint8)
        base = np.cumsum(sizes) - sizes - left
        for c in range(wide):
            own = np.flatnonzero((left <= c) & (c < left + sizes))
            column = np.zeros(n, np.uint16)
            column[own] = flat[base[own] + c]
            column[own] += 1
            file.write(column.tobytes())
        del flat
        order = np.arange(n)
        parts = np.full(n + 1, wide, np.int64)
        parts[np.flatnonzero(np.diff(buckets, prepend=-1))] = -1  # nothing is shared across buckets
        small = buckets.astype(np.uint16) if n < 1 << 16 else buckets
        hit = np.zeros((n, zero + 1), bool)
        for c in range(wide - 1, -1, -1):
            file.seek(2 * n * c)
            symbol = np.frombuffer(file.read(2 * n), np.uint16)[order]
            by = np.argsort(symbol, kind="stable")
            moved = by[np.argsort(small[order[by]], kind="stable")]
            after, sign = order[moved], symbol[moved]
            same = np.zeros(n, bool)
            own = buckets[after]
            same[1:] = (sign[1:] == sign[:-1]) & (own[1:] == own[:-1]) & (sign[1:] > 0)
            new = np.full(n + 1, c, np.int64)
            k = np.flatnonzero(same)
            if len(k):
                pairs = np.stack((moved[k - 1] + 1, moved[k] + 1), axis=1).reshape(-1)
                new[k] = np.minimum.reduceat(parts, pairs)[::2]
            order, parts = after, new
            if c <= zero:
                far = parts[:n] - c >= length
                hit[order[far], c] = True
                hit[order[np.flatnonzero(far) - 1], c] = True
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    rows, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, a, b in zip(rows.tolist(), (begin - left[rows]).tolist(), (end - left[rows]).tolist()):
        out[r].append((a, b))
    return out


SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = "s1 long, s2 long, spans array<struct<a:int,b:int>>"


def _runs(length: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            for part in pieces_of(batch, 3, RUN_BYTES):
                data = pc.fill_null(part.column(3), b"")
                bounds = np.frombuffer(data.buffers()[1], np.int32, len(data) + data.offset + 1)[data.offset :].astype(np.int64)
                raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
                text, start, count, left, key = anchored_runs(raw, bounds - bounds[0], length, grain)
                pick = pa.array(text)
                yield pa.record_batch(
                    [part.column(0).take(pick), part.column(1).take(pick), part.column(2).take(pick), pa.array(key), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(left, pa.int32())],
                    ["s1", "s2", "weight", "key", "start", "n", "left"],
                )
        tidy()

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "start", "weight", "key", "left", "h1", "h2", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows, size = [], 0
            s1, s2, weight, data, runs = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                text = data[i].as_py()
                for r in runs[i].as_py():
                    piece = text[r["start"] : r["start"] + r["n"] + length - 1]
                    digest = xxhash.xxh3_128_intdigest(piece, r["left"])
                    rows.append((s1[i].as_py(), s2[i].as_py(), r["start"], weight[i].as_py(), r["key"], r["left"], signed(digest >> 64), signed(digest & (1 << 64) - 1), piece))
                    size += len(piece)
                    if size > SLICE_BYTES:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def _sorted_buckets(length: int):
    """From rows in the order of their keys: whole buckets at a time, as many as BATCH_STRINGS allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            keys = np.array([r[0] for r in rows])
            buckets = np.concatenate(([0], np.cumsum(np.diff(keys) != 0)))
            found = repeated_windows([r[5] for r in rows], np.array([r[4] for r in rows]), buckets, length)
            spans = [[(0, len(r[5]) - length + 1)] if r[3] > 1 else f for r, f in zip(rows, found)]
            keep = [i for i, s in enumerate(spans) if s]
            return pa.record_batch(
                [pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([rows[i][2] for i in keep], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in keep], SPAN)], ["s1", "s2", "spans"]
            )

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= BATCH_STRINGS and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield done(rows)
        tidy()

    return run


def repeats(strings: DataFrame, length: int, grain: int, most: int) -> DataFrame:
    """(s1, s2, spans of windows) of ``strings(s1, s2, weight, data)`` that hold a window which starts elsewhere too."""
    strings = strings.select("s1", "s2", "weight", "data")
    runs = stash(strings.mapInArrow(_runs(length, grain), "s1 long, s2 long, weight long, key long, start int, n int, left int"), "runs")
    again = runs.groupBy("key").agg(F.sum("weight").alias("times")).where("times > 1").select("key")
    again = stash(again, "anchors")  # apart from the join, so that Spark can split an anchor that very many texts hold
    per = runs.join(again, "key").groupBy("s1", "s2").agg(F.collect_list(F.struct("start", "n", "left", "key")).alias("runs"))
    cut = strings.join(per, ["s1", "s2"]).select("s1", "s2", "weight", "data", "runs")
    cut = stash(cut.mapInArrow(_cut(length), "s1 long, s2 long, start int, weight long, key long, left int, h1 long, h2 long, data binary"), "strings")
    for done in (runs, again):
        unstash(done)
    own = cut.groupBy("key", "h1", "h2").agg(F.sum("weight").alias("weight"), F.first("left").alias("left"), F.first("data").alias("data"))
    own = stash(own, "distinct")
    hot = stash(own.groupBy("key").count().where(F.col("count") > most).select("key"), "hot")
    deeper = grain < length and not hot.isEmpty()
    calm = own.join(hot, "key", "left_anti") if deeper else own
    calm = calm.repartition("key").sortWithinPartitions("key").select("key", "h1", "h2", "weight", "left", "data")
    found = calm.mapInArrow(_sorted_buckets(length), FOUND)
    if deeper:
        rest = own.join(hot, "key", "left_semi").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "weight", "data")
        found = found.unionByName(repeats(rest, length, (grain + length + 1) // 2, most))
    found = stash(found, "found")
    for done in (own, hot):
        unstash(done)
    back = cut.select("s1", "s2", "start", "h1", "h2").join(found.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), "spans"), ["h1", "h2"])
    back = back.select("s1", "s2", F.expr("transform(spans, x -> struct(cast(x.a + start as int) as a, cast(x.b + start as int) as b))").alias("spans"))
    return back.groupBy("s1", "s2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keep_bytes(data: bytes, spans: list[dict], length: int) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs); spans are ranges of window starts."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in spans):
        if a > end:
            runs += 1
            kept.append(data[at:a])
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def dedup_substrings(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept: the bytes that stay, as binary."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("data"))
    # Equal rows are one string with a weight; its key tells rows with one doc_id apart.
    keyed = own.select(F.coalesce("doc_id", F.lit(-1)).alias("s1"), F.xxhash64("doc_id", "data").alias("s2"), F.lit(1).cast("long").alias("weight"), "data", "doc_id")
    found = repeats(keyed, length, grain, most)
    joined = keyed.join(found, ["s1", "s2"], "left").select("doc_id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, SLICE_BYTES):
                rows = [keep_bytes(d, s, length) if s else (d, 0, 0) for d, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                kept, removed, runs = zip(*rows)
                yield pa.record_batch(
                    [part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir):
    """The contract's columns, and text: what stays, where a cut inside a character leaves a replacement character."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
