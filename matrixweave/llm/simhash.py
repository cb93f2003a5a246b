"""SimHash near-dedup by multi-index hashing.

``fingerprints64`` is the plain form: 64 bits of the shingles' XXH64, cut into two
32-bit segments.  Two fingerprints within two bits either agree on the second segment,
or differ by at most one bit in the first; so each fingerprint looks up its first
segment, the segments that arise by setting one of its unset bits (the partner with
the bit set is the table side), and its second segment, and whole distances of what
is found are verified.

Equal fingerprints are one node.  A segment value that more than ``most`` fingerprints
share is not paired within itself: its members get keys in which two bits are masked.
Two fingerprints have a masked key in common exactly if they differ in those bits at
most, and at most four fingerprints can share one, so each key links its members to
their smallest, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import connected_components, pieces_of, small_batches, stash

WORDS, SEED, DISTANCE = 3, 42, 2
MOST = 512
SLICE_BYTES = 4 << 20


def bit_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit (from the lowest) set: texts x 64.

    Eight bits at a time are spread over the bytes of a word, and at most 255 words
    are summed before the bytes are taken apart.
    """
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), 64), np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    blocks = -(-lengths[full] // 255)
    text = np.repeat(full, blocks)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = offsets[text] + inner * 255
    first = np.concatenate(([True], np.diff(text) != 0))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        bytes_ = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, k::8] = np.add.reduceat(bytes_, np.flatnonzero(first), axis=0)
    return out


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is set if over half its hashes have it; no hash: zero."""
    bits = 2 * bit_counts(hashes, offsets) > np.diff(offsets)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; fewer words: of the whole sequence; none: nothing."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends]
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])]


def fingerprints64(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, repeated rows included; null, empty and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, SLICE_BYTES):
                rows = [shingle_hashes(t, words, seed) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
                hashes = np.fromiter((h for r in rows for h in r), np.uint64, int(offsets[-1]))
                yield pa.record_batch([part.column(0), pa.array(majority(hashes, offsets).view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


HIGH, LOW = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
#: Masks of two bits: both low, both high, and one of each. (bit numbers from the lowest)
BOTH_LOW = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
BOTH_HIGH = BOTH_LOW.replace("sequence(0, 30)", "sequence(32, 62)").replace("31)", "63)")


def links2(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v) of distinct fingerprints ``nodes(fp)``, enough to join all that are within two bits; every pair is a link."""
    table = nodes.select("fp", F.explode(F.expr(f"array(struct(0 as seg, {HIGH} as key), struct(1 as seg, {LOW} as key))")).alias("t")).select("fp", "t.*")
    hot = stash(table.groupBy("seg", "key").count().where(F.col("count") > most).select("seg", "key"), "hot")
    few = table.join(hot, ["seg", "key"], "left_anti").withColumnRenamed("fp", "v")
    probes = nodes.select(
        F.col("fp").alias("u"),
        F.explode(
            F.expr(
                f"concat(array(struct(0 as seg, {HIGH} as key, -1 as bit), struct(1 as seg, {LOW} as key, -1 as bit)),"
                f" transform(filter(sequence(0, 31), i -> ({HIGH}) & shiftleft(1L, i) = 0L), i -> struct(0 as seg, ({HIGH}) | shiftleft(1L, i) as key, i as bit)))"
            )
        ).alias("p"),
    ).select("u", "p.*")
    near = probes.join(few, ["seg", "key"]).where("(bit >= 0 or u < v) and bit_count(u ^ v) <= 2").select("u", "v")
    if hot.isEmpty():
        return near
    members = table.join(hot, ["seg", "key"]).select(
        "fp",
        F.expr(
            f"case when seg = 0 then concat({BOTH_LOW}, flatten(transform(filter(sequence(32, 63), i -> fp & shiftleft(1L, i) <> 0L), i -> transform(sequence(0, 31), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
            f" else {BOTH_HIGH} end"
        ).alias("masks"),
    )
    callers = probes.where("bit >= 0").join(hot, ["seg", "key"]).select(
        F.col("u").alias("fp"), F.expr("transform(sequence(0, 31), j -> shiftleft(1L, bit + 32) | shiftleft(1L, j))").alias("masks")
    )
    keys = members.unionByName(callers).select("fp", F.explode("masks").alias("mask")).select("fp", "mask", F.expr("fp & ~mask").alias("rest"))
    shared = keys.groupBy("mask", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = shared.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v")
    return near.unionByName(star)


def components2(prints: DataFrame, most: int = MOST) -> DataFrame:
    """``prints(doc_id, fp)`` plus component_id, the smallest doc_id reachable over links of two bits or fewer.

    Fingerprint zero links like any other.  Null doc_ids are never the smallest, unless there is no other.
    """
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    joined = connected_components(links2(nodes.select("fp"), most))
    groups = nodes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    # A linked fingerprint has its row here; the others keep their own smallest document.
    return prints.join(groups.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp")


def op10_simhash(spark, sf_dir):
    prints = stash(fingerprints64(spark.read.parquet(f"{sf_dir}/documents.parquet")), "simhash")
    return components2(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
