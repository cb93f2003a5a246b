"""Near copies: looked up by minima of shingle hashes, compared by SimHash and by shared shingles.

Words are compared without case and punctuation; texts of equal words are one node.  A
text's distinct ``WORDS``-word shingles give it ``BANDS`` values, each of ``MINIMA``
least hashes.  Two texts with a share s of their shingles in common (Jaccard) agree in
each value with probability s ** MINIMA, whatever the edit is that parts them and
wherever it lies: at 0.8 a pair agrees in none of 25 values twice in a million.
Unrelated texts hardly ever meet.

Before that come the links of operator 10: fingerprints of 64 bits within two bits, found by
multi-index hashing.  As they also join short texts that differ much, the exact share of
shingles decides each of them.  A pair at the similarity differs in more bits as a rule, so
the values are looked up besides.

What meets at one value is compared by a SimHash of 512 bits of the shingles.  The
fingerprints agree in the angle with cosine 2s / (1 + s), so at 0.8 they differ in 77.6
of 512 bits on average, with a deviation of 8.1.  Texts within ``SURE_BITS``, over four
deviations less, are linked; of all others that meet the shingles are compared.

At a value of up to ``FEW`` texts these are all pairs.  At a larger one the sure links
are a spanning forest; where they and the small values leave texts of one value apart,
the texts meet there once more with their shingles, and each is compared with all that
nothing has joined to it yet.  So no pair at the similarity stays apart that meets, and a
group of n near copies gives n - 1 links, not all its pairs.

A value of more than ``BLOCK`` texts is dealt into blocks of about that many, each a task's
own cell.  Where that leaves texts of the value apart, those outside its largest group
meet each block of that group and each other, two blocks in a cell.  So no cell holds
more than two blocks, however many texts share a value, and no pair is left out but those
that are joined already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import carried, claim, connected_components, gram_hashes, mixed, pieces_of, released, small_batches, stash, tidy
from matrixweave.llm.simhash import fingerprints64, links2, majority
from matrixweave.llm.string_tiling import word_hashes

WORDS, SIMILARITY = 5, 0.8
SURE_BITS = 40
BANDS, MINIMA = 25, 4
SLICE_BYTES = 4 << 20
#: Rows of whole values that are compared at a time, and rows of one value up to which all its pairs are.
BATCH_ROWS, FEW = 1 << 16, 16
#: Texts of one value that one task holds, about.
BLOCK = 1024
SHINGLE_LANES = 8
#: Keep the lanes of a fingerprint apart.
SALTS = mixed(np.arange(SHINGLE_LANES, dtype=np.uint64))
#: One hash function a minimum: bits that are flipped, and an odd factor.
FLIPS = mixed(np.arange(1 << 20, (1 << 20) + BANDS * MINIMA, dtype=np.uint64))
FACTORS = mixed(FLIPS) | np.uint64(1)


def wide_prints(hashes: np.ndarray, offsets: np.ndarray, lanes: int) -> np.ndarray:
    """Fingerprints of 64 bits a lane of hashes by text: texts x lanes."""
    return np.stack([majority(mixed(hashes ^ s), offsets) for s in SALTS[:lanes]], axis=1)


def distinct_by_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.concatenate(([True], (np.diff(hashes) != 0) | (np.diff(text) != 0))) if len(hashes) else np.zeros(0, bool)
    return hashes[first], np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=len(offsets) - 1)))).astype(np.int64)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs; a text of fewer words has one, of all its words."""
    found, bounds = gram_hashes(words, offsets, n)
    short = np.flatnonzero((np.diff(offsets) < n) & (np.diff(offsets) > 0))
    if not len(short):
        return found, bounds
    counts = np.diff(bounds)
    counts[short] = 1
    extra = sequence_hashes(words, offsets)[short, 0]
    return np.insert(found, bounds[short], extra), np.concatenate(([0], np.cumsum(counts)))


def sequence_hashes(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two hashes of each text's words in their order: texts x 2."""
    lengths = np.diff(offsets)
    place = (np.arange(len(words)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
    out = np.zeros((len(lengths), 2), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        for k in range(2):
            out[full, k] = np.add.reduceat(mixed(words ^ mixed(place + SALTS[k])), offsets[full])
    return out


def band_values(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values of each text that has shingles: such texts x BANDS."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts):
        for band in range(BANDS):
            value = np.full(len(starts), band, np.uint64)
            for k in range(band * MINIMA, (band + 1) * MINIMA):
                value = mixed(value ^ np.minimum.reduceat((hashes ^ FLIPS[k]) * FACTORS[k], starts))
            out[:, band] = value
    return out


def text_prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, h1, h2, g0..g7 of shingles, values) of each row; null texts have no words and no values."""
    names = ["doc", "h1", "h2", *(f"g{k}" for k in range(SHINGLE_LANES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes")
        hashed = word_hashes()
        for batch in batches:
            for part in pieces_of(batch, 1, SLICE_BYTES):
                found, offsets = hashed(part.column(1))
                own, bounds = distinct_by_text(*shingles(found, offsets, words))
                columns = np.hstack([sequence_hashes(found, offsets), wide_prints(own, bounds, SHINGLE_LANES)])
                values = pa.array(band_values(own, bounds).reshape(-1).view(np.int64))
                places = pa.array(np.concatenate(([0], np.cumsum((np.diff(bounds) > 0) * BANDS))), pa.int32())
                yield pa.record_batch([part.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.T), pa.ListArray.from_arrays(places, values)], [*names, "values"])
        tidy()

    small_batches(docs.sparkSession)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", values array<long>")


def linked(ids: np.ndarray, prints: np.ndarray, sure: int, most: int) -> list[tuple[int, int, int]]:
    """(u, v, bits) of a spanning forest of links of at most ``most`` bits.

    What is within ``sure`` bits of a text is joined to it at once; then the text that
    is nearest to any joined one is, and the search goes on from it.
    """
    out = []
    left = np.arange(len(ids))
    least, parent = np.full(len(ids), 1 << 30), np.zeros(len(ids), np.int64)
    stack: list[int] = []
    while len(left):
        if stack:
            x = stack.pop()
        else:
            k = int(least[left].argmin())
            x = int(left[k])
            if least[x] <= most:
                out.append((int(ids[parent[x]]), int(ids[x]), int(least[x])))
            else:
                least[left] = 1 << 30
            left = np.delete(left, k)
        if not len(left):
            break
        bits = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1, dtype=np.int64)
        closer = bits < least[left]
        least[left[closer]], parent[left[closer]] = bits[closer], x
        near = bits <= sure
        out += [(int(ids[x]), int(ids[y]), int(n)) for y, n in zip(left[near], bits[near])]
        stack += left[near].tolist()
        left = left[~near]
    return out


def whole_values(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.Table]:
    """Rows of whole values, the first column, from batches in its order; about ``most_rows`` at a time, or one value."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most_rows and batch.column(0)[-1] != held[0].column(0)[0]:
            own = pa.Table.from_batches(held)
            key = np.asarray(own.column(0))
            cut = int(np.searchsorted(key, key[-1]))  # the last value may go on
            yield own.slice(0, cut)
            held, rows = own.slice(cut).to_batches(), len(key) - cut
    if held:
        yield pa.Table.from_batches(held)


def starts_of(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))


def links_at_values(sure: int):
    """(u, v, bits, key): pairs of small values and sure links of large ones; (node, node, -1, key) of the texts of a large one that those leave apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_values(batches, BATCH_ROWS):
            key, ids = np.asarray(table.column(0)), np.asarray(table.column(1))
            prints = np.stack([np.asarray(c) for c in table.columns[2:]], axis=1).view(np.uint64)
            starts = starts_of(key)
            sizes = np.diff(np.append(starts, len(key)))
            size = np.repeat(sizes, sizes)
            pairs, apart = [], []
            for step in range(1, FEW):
                i = np.flatnonzero((key[:-step] == key[step:]) & (size[:-step] <= FEW))
                bits = np.bitwise_count(prints[i] ^ prints[i + step]).sum(axis=1, dtype=np.int64)
                pairs.append(np.stack([ids[i], ids[i + step], bits], axis=1))
            for k in np.flatnonzero(sizes > FEW):
                s = slice(starts[k], starts[k] + sizes[k])
                links = linked(ids[s], prints[s], sure, sure)
                pairs.append(np.array(links, np.int64).reshape(-1, 3))
                if len(links) < sizes[k] - 1:
                    apart.append(np.arange(s.start, s.stop))
            found = np.concatenate(pairs)
            found[:, :2] = np.sort(found[:, :2], axis=1)
            found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
            at = np.concatenate([*apart, np.zeros(0, np.int64)]).astype(np.int64)
            rest = np.stack([ids[at], ids[at], np.full(len(at), -1)], axis=1)
            out = np.concatenate((found, rest))
            keys = np.concatenate((np.zeros(len(found), np.int64), key[at]))
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)), pa.array(keys)], ["u", "v", "bits", "key"])

    return run


def joined(ids: np.ndarray, group: np.ndarray, codes: np.ndarray, offsets: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of texts that share ``similarity`` of their shingles, enough to join all that such pairs join.

    Texts of one ``group`` are joined already.  ``codes`` are small numbers of each text's distinct shingles.
    """
    out = []
    sizes = np.diff(offsets)
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, flat, starts = np.arange(len(ids)), codes, offsets[:-1]
    stack: list[int] = []
    while len(left):
        if stack:
            x = stack.pop()
            own = codes[offsets[x] : offsets[x + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            near = left[shared >= similarity * (sizes[x] + sizes[left] - shared)]
            if not len(near):
                continue
            out += [(int(ids[x]), int(ids[y])) for y in near]
            take = np.isin(group[left], group[near])
        else:
            take = group[left] == group[left[0]]
        stack += left[take].tolist()
        left = left[~take]
        bounds = np.concatenate(([0], np.cumsum(sizes[left])))
        flat = codes[np.repeat(offsets[left] - bounds[:-1], sizes[left]) + np.arange(bounds[-1])]
        starts = bounds[:-1]
    return out


def joined_at_values(similarity: float):
    """(u, v) of rows (key, group, node, shingles) in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_values(batches, 1):
            starts = starts_of(np.asarray(table.column(0)))
            links = []
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                group, ids = (np.asarray(table.column(k).slice(a, b - a)) for k in (1, 2))
                sets = table.column(3).slice(a, b - a).combine_chunks()
                offsets = np.concatenate(([0], np.cumsum(np.asarray(sets.value_lengths())))).astype(np.int64)
                codes = np.unique(np.asarray(sets.flatten()), return_inverse=True)[1]
                links += joined(ids, group, codes, offsets, similarity)
            if links:
                own = np.array(links, np.int64)
                yield pa.record_batch([pa.array(np.ascontiguousarray(own[:, k])) for k in range(2)], ["u", "v"])
        tidy()

    return run


def shingle_sets(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, s) of each of ``ids(id)``, written: the distinct shingles; only those texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes")
        hashed = word_hashes()
        for batch in batches:
            for part in pieces_of(batch, 1, SLICE_BYTES):
                own, bounds = distinct_by_text(*shingles(*hashed(part.column(1)), words))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(own.view(np.int64)))], ["id", "s"])
        tidy()

    ends = stash(ids.distinct(), "near-ends")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ends, "id", "left_semi")
    sets = texts.mapInArrow(run, "id long, s array<long>").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    return stash(sets, "near-shingles")


def similar(edges: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The ``edges(u, v)`` whose texts share at least ``similarity`` of their distinct shingles."""
    sets = shingle_sets(edges.select(F.explode(F.array("u", "v")).alias("id")), docs, words, id_col, text_col)
    both = edges.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    both = both.withColumn("n", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("n") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("n"))).select("u", "v")


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows(key, node, n, ...)``, n rows a key, with blocks of about ``block`` rows, each row's block and its cell.

    A small value is its own cell.  Cells whose hashes meet only compare more.  Each value
    deals its texts anew, so what one leaves in different blocks meets at another.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    return rows.withColumn("cell", F.when(F.col("blocks") > 1, F.xxhash64("key", "block")).otherwise(F.col("key")))


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def still_apart(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` whose rows are of more than one group."""
    return rows.groupBy(key).agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select(key)


def block_pairs(rows: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(cell, node) of ``rows(key, node)``, in which all of a value that are still apart meet.

    The texts of a value's largest group are joined already, so its blocks need not meet
    each other: the others, in blocks of their own, meet every block of it, and
    each other two by two.
    """
    rows = stash(grouped(rows.select("key", "node"), groups), "blocks")
    sizes = stash(rows.groupBy("key", "group").agg(F.count("*").alias("c")), "block-groups")
    sizes = sizes.groupBy("key").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("n")).where("c < n")
    sizes = sizes.select("key", "main", F.ceil(F.col("c") / block).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("c")) / block).cast("int").alias("others"))
    rows = rows.join(stash(sizes, "blocks-apart"), "key").withColumn("in_main", F.expr("`group` = main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("others")).otherwise(F.col("mains")) - 1)
    across = rows.select("key", "node", "in_main", "block", F.explode(meets).alias("other"))
    across = across.select(F.xxhash64("key", F.lit(0), F.when(F.col("in_main"), F.col("other")).otherwise(F.col("block")), F.when(F.col("in_main"), F.col("block")).otherwise(F.col("other"))).alias("cell"), "node")
    among = rows.where("not in_main and others > 1").select("key", "node", "block", F.explode(F.expr("sequence(0, others - 1)")).alias("other")).where("other <> block")
    among = among.select(F.xxhash64("key", F.lit(1), F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node")
    return across.unionByName(among)


def joined_in_cells(rows: DataFrame, edges: DataFrame, groups: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> tuple[DataFrame, DataFrame]:
    """``edges`` and their components with what the shingles of ``rows(cell, node)`` link in cells that ``groups`` leave apart."""
    apart = stash(grouped(rows.distinct(), groups), "apart")
    apart = stash(apart.join(stash(still_apart(apart, "cell"), "apart-cells"), "cell"), "apart")
    if apart.isEmpty():
        return edges, groups
    own = apart.join(sets(apart.select(F.col("node").alias("id"))).withColumnRenamed("id", "node"), "node")
    own = own.select("cell", "group", "node", "s").repartition("cell").sortWithinPartitions("cell", "node")
    links = stash(own.mapInArrow(joined_at_values(similarity), "u long, v long"), "near-joined")
    edges = edges.unionByName(links)
    return edges, connected_components(edges)


def simhash_links(docs: DataFrame, own: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v) of the nodes of ``own(doc, node)`` that operator 10 links and whose texts share ``similarity`` of their shingles.

    Texts of one fingerprint are compared with the smallest node of it, and linked
    fingerprints by their smallest; what is not so joined is left to the values.
    """
    prints = fingerprints64(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col).withColumnRenamed("doc_id", "doc")
    prints = stash(prints.join(own, "doc").select("node", "fp").distinct(), "near-simhash")
    least = stash(prints.groupBy("fp").agg(F.min("node").alias("least")), "near-simhash-least")
    same = prints.join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    met = links2(least.select("fp"))
    for end in ("u", "v"):
        met = met.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_")), end)
    met = met.select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).where("u <> v")
    return similar(stash(same.unionByName(met).distinct(), "near-simhash-met"), docs, words, similarity, id_col, text_col)


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, sure: int = SURE_BITS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc, group) of each doc_id; group is the smallest doc_id of the near copies that it is linked to, itself included.

    Texts without words are copies of each other.  Rows that repeat a doc_id are texts
    of one document: their groups are one.  Null doc_ids have no row.
    """
    prints = stash(text_prints(docs, words, id_col, text_col), "prints")
    gs = [f"g{k}" for k in range(SHINGLE_LANES)]
    nodes = prints.groupBy("h1", "h2").agg(F.min("doc").alias("node"), *[F.first(c).alias(c) for c in [*gs, "values"]])
    nodes = stash(nodes, "print-nodes")
    table = nodes.select("node", F.explode("values").alias("key"), *gs)
    live = stash(table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "live-values")
    rows = dealt(table.join(live, "key"), block)
    rows = rows.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", *gs)
    met = stash(rows.mapInArrow(links_at_values(sure), "u long, v long, bits long, key long"), "near-met")
    found = stash(met.where("bits >= 0").groupBy("u", "v").agg(F.min("bits").alias("bits")), "near-links")
    edges = found.where(F.col("bits") <= sure).select("u", "v").unionByName(similar(found.where(F.col("bits") > sure).select("u", "v"), docs, words, similarity, id_col, text_col))
    # Rows of one document are joined too.
    own = stash(prints.select("doc", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc", "node"), "near-own")
    edges = edges.unionByName(simhash_links(docs, own, words, similarity, id_col, text_col))
    edges = stash(edges.unionByName(own.where("doc <> node").select(F.col("doc").alias("u"), F.col("node").alias("v"))), "near-edges")
    sets = lambda ids: shingle_sets(ids, docs, words, id_col, text_col)
    groups = connected_components(edges)
    edges, groups = joined_in_cells(met.where("bits < 0").select(F.col("key").alias("cell"), F.col("u").alias("node")), edges, groups, sets, similarity)
    large = live.where(F.col("n") > block)
    if not large.isEmpty():
        large = nodes.select("node", F.explode("values").alias("key")).join(large, "key")
        _, groups = joined_in_cells(block_pairs(large, groups, block), edges, groups, sets, similarity)
    groups = groups.withColumnRenamed("node", "doc").withColumnRenamed("component", "group")
    return prints.select("doc").distinct().join(groups, "doc", "left").select("doc", F.coalesce("group", "doc").alias("group"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the smallest doc_id of each group of near copies; rows without doc_id stay."""
    gone = near_groups(docs, words, similarity, id_col=id_col, text_col=text_col).where(F.col("group") != F.col("doc")).select(F.col("doc").alias("_gone"))
    return released(carried(docs, id_col, text_col).join(gone, F.col("_id") == F.col("_gone"), "left_anti"), docs)
