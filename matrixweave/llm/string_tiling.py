"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation.  Every run of ``least`` words of a
benchmark item is a seed, with a Karp-Rabin fingerprint; the fingerprints of a
document's runs are rolled over its words and looked up among the seeds, each once a
text.  Where the seeds found could cover ``threshold`` of an item's words, document and
item are tiled: places that agree on one diagonal make a maximal match, and the longest
match whose words are all unmarked is marked again and again, so that passages are found
in any order and no word counts twice.  A document is contaminated by an item if the
tiles cover at least ``threshold`` of its words.

Matches come from pairs of equal fingerprints; where words repeat so often that there
are more than ``MOST_PAIRS``, from one row of run lengths an item's word instead, which
needs memory for the text's seeds only.

The seeds go to every task while the benchmark has at most ``most_bytes`` of text;
beyond that, fingerprints of documents and seeds meet in a join, which gives the same
rows.  Null and empty texts, of either side, match nothing; an item of fewer words than
``least`` must occur whole.  Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import carried, claim, memory, pieces_of, released, small_batches, split_words, stash, tidy

LEAST, THRESHOLD = 4, 0.6
MOST_BYTES = 32 << 20
SLICE_BYTES = 8 << 20
#: Equal fingerprints of an item and a text that are paired, and seeds that are listed at a time.
MOST_PAIRS, MOST_SEEDS = 1 << 20, 1 << 22
MOST_WORDS = 1 << 18
#: The base of the fingerprints: a fixed odd number.
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = np.uint64(22)


class Words:
    """The hash of each word without case and punctuation, 0 if nothing is left; a worker remembers words it has seen."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the texts, one after another, and offsets by text."""
        codes, distinct, offsets = split_words(text)
        keys, seen = distinct.to_pylist(), self.seen
        if len(seen) > MOST_WORDS:
            seen.clear()
        for w in keys:
            if w not in seen:
                k = w.lower()
                if not k.isalnum():
                    k = "".join(filter(str.isalnum, k))
                seen[w] = xxhash.xxh64_intdigest(k) | 1 if k else 0
        hashes = np.fromiter(map(seen.__getitem__, keys), np.uint64, len(keys))[codes]
        full = hashes != 0
        if not full.all():
            offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
            hashes = hashes[full]
        return hashes, offsets


@functools.lru_cache(1)
def word_hashes() -> Words:
    """One memory of words for a Python worker, from task to task."""
    return Words()


memory("word hashes", word_hashes.cache_clear)


def fingerprints(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of all runs of ``n`` words within a text: (fingerprint, text, position of its first word)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = total * BASE + words[k : len(words) - n + 1 + k]
    inside = text[: len(total)] == text[n - 1 :]
    at = np.flatnonzero(inside)
    return total[at], text[at], at - offsets[text[at]]


class Seeds:
    """The seeds of a benchmark by fingerprint."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST):
        words, offsets = Words()(pa.array([t for _, t in items], pa.string()))
        self.items = [i for i, _ in items]
        self.words, self.offsets = words, offsets
        self.length = np.diff(offsets)
        self.need = np.minimum(least, self.length)
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({int(x) for x in self.need if x}):
            own = [i for i in range(len(items)) if self.need[i] == n]
            part = np.concatenate([words[offsets[i] : offsets[i + 1]] for i in own])
            prints, item, at = fingerprints(part, np.concatenate(([0], np.cumsum(self.length[own]))), n)
            order = np.argsort(prints, kind="stable")
            prints, item, at = prints[order], np.asarray(own)[item[order]], at[order]
            table = np.zeros(1 << int(TABLE_BITS), bool)
            table[prints >> (np.uint64(64) - TABLE_BITS)] = True
            self.by[n] = prints, item, at, table

    def candidates(self, words: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(text, number of the item) of pairs whose common seeds could cover ``threshold`` of the item."""
        for n, (prints, item, at, table) in self.by.items():
            found, text, _ = fingerprints(words, offsets, n)
            near = np.flatnonzero(table[found >> (np.uint64(64) - TABLE_BITS)])
            low = np.searchsorted(prints, found[near], "left")
            low[low == len(prints)] = 0
            hit = prints[low] == found[near]
            text, low = np.divmod(np.unique(text[near[hit]] * len(prints) + low[hit]), len(prints))
            count = np.searchsorted(prints, prints[low], "right") - low
            borders = np.flatnonzero(np.diff(text, prepend=-1))
            total = np.concatenate(([0], np.cumsum(count)))[[*borders, len(text)]]
            start = 0
            while start < len(borders):
                end = max(start + 1, int(np.searchsorted(total, total[start] + MOST_SEEDS, side="right")) - 1)
                own = slice(borders[start], borders[end] if end < len(borders) else len(text))
                rows = np.repeat(np.arange(own.start, own.stop), count[own])
                pick = np.repeat(low[own] - np.cumsum(count[own]) + count[own], count[own]) + np.arange(len(rows))
                t, i, a = text[rows], item[pick], at[pick]
                order = np.lexsort((a, i, t))
                t, i, a = t[order], i[order], a[order]
                new = np.concatenate(([True], (np.diff(t) != 0) | (np.diff(i) != 0)))
                first = np.flatnonzero(new)
                # No tiling covers more than all the seeds do.
                gain = np.where(np.append(new[1:], True), n, np.minimum(np.diff(a, append=0), n))
                most = np.add.reduceat(gain, first)
                for k in np.flatnonzero(most >= threshold * self.length[i[first]]):
                    yield int(t[first[k]]), int(i[first[k]])
                start = end


def paired_matches(in_item: np.ndarray, in_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, start in the item, start in the text) of each maximal match, from all places where ``least`` words agree."""
    order = np.lexsort((in_item, in_text - in_item))
    i, diagonal = in_item[order], (in_text - in_item)[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(diagonal) != 0) | (np.diff(i) > 1)))[: len(i)])
    ends = np.append(starts[1:], len(i))[: len(starts)] - 1
    return i[ends] - i[starts] + least, i[starts], i[starts] + diagonal[starts]


def rolled_matches(item: np.ndarray, text: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the words themselves; ``places`` are those of the text where a seed of the item begins."""
    covered = np.zeros(len(text) + 1, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + least, -1)
    at = np.flatnonzero(np.cumsum(covered)[:-1])
    # Words that no seed covers are left out, and a word that is in no item stands where they were.
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    words, at = np.insert(text[at], gaps, 0), np.insert(at, gaps, -1)
    run = np.zeros(len(words) + 1, np.int32)
    found = []
    same = words == item[-1]
    for a in range(len(item) - 1, -1, -1):
        run[:-1] = np.where(same, run[1:] + 1, 0)
        same = words == item[a - 1] if a else np.zeros(len(words), bool)
        begins = run[:-1] >= least
        begins[1:] &= ~same[:-1]
        b = np.flatnonzero(begins)
        found.append((run[b].astype(np.int64), np.full(len(b), a), at[b]))
    sizes, a, b = map(np.concatenate, zip(*found))
    return sizes, a, b


def all_matches(item: np.ndarray, text: np.ndarray, least: int, most_pairs: int = MOST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, start in the item, start in the text) of each maximal match of ``least`` words or more."""
    seeds, _, at = fingerprints(item, np.array([0, len(item)]), least)
    spots, _, place = fingerprints(text, np.array([0, len(text)]), least)
    order = np.argsort(seeds, kind="stable")
    seeds, at = seeds[order], at[order]
    low = np.searchsorted(seeds, spots, "left")
    count = np.searchsorted(seeds, spots, "right") - low
    if count.sum() > most_pairs:
        return rolled_matches(item, text, place[count > 0], least)
    pick = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    return paired_matches(at[pick], np.repeat(place, count), least)


def marked(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, words) of each tile, from the maximal matches.

    Longer matches come first, then smaller starts in the item and the text.  What is
    left unmarked of a match that another one has cut waits for its own length.
    """
    tiles: list[tuple[int, int, int]] = []
    if not len(sizes):
        return tiles
    order = np.lexsort((b, a, -sizes))
    sizes, a, b = sizes[order], a[order], b[order]
    step = np.zeros(int((a + sizes).max()) + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, a + sizes, -1)
    item_free, text_free = np.cumsum(step)[:-1] > 0, np.ones(int((b + sizes).max()), bool)
    stretches = lambda free: np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8))).reshape(-1, 2)
    rest: list[tuple[int, int, int]] = []
    at = 0
    while at < len(sizes) or rest:
        if at < len(sizes) and (not rest or (-sizes[at], a[at], b[at]) < rest[0]):
            size, x, y = int(sizes[at]), int(a[at]), int(b[at])
            at += 1
        else:
            size, x, y = heapq.heappop(rest)
            size = -size
        free = item_free[x : x + size] & text_free[y : y + size]
        if not free.all():
            for s, e in stretches(free).tolist():
                if e - s >= least:
                    heapq.heappush(rest, (s - e, x + s, y + s))
            continue
        tiles.append((x, y, size))
        item_free[x : x + size] = text_free[y : y + size] = False
        left = stretches(item_free)
        if not len(left) or np.diff(left).max() < least:
            break
    return tiles


def greedy_tiles(in_item: np.ndarray, in_text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, words) of each tile, from all places where ``least`` words agree."""
    return marked(*paired_matches(in_item, in_text, least), least)


def found(seeds: Seeds, words: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, list]]:
    """(text, number of the item, words covered, tiles) of each contaminated text."""
    for text, k in seeds.candidates(words, offsets, threshold):
        n = int(seeds.need[k])
        item = seeds.words[seeds.offsets[k] : seeds.offsets[k + 1]]
        tiles = marked(*all_matches(item, words[offsets[text] : offsets[text + 1]], n), n)
        covered = sum(x for _, _, x in tiles)
        if covered >= threshold * len(item):
            yield text, k, covered, tiles


def benchmark_bytes(benchmark: DataFrame, text_col: str = "text") -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def collect_seeds(benchmark: DataFrame, least: int = LEAST, id_col: str = "item_id", text_col: str = "text") -> Seeds:
    """The seeds of a benchmark whose size has been checked."""
    return Seeds(sorted(((r[0], r[1]) for r in benchmark.select(id_col, text_col).where(f"{text_col} is not null").collect()), key=lambda x: (x[0] is None, x)), least)


OUT = "doc_id long, item_id long, words int, covered int, coverage double, tiles array<struct<item_at:int,text_at:int,words:int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, words, covered, coverage, tiles) of each document and item that contaminates it."""
    small_batches(docs.sparkSession)
    if benchmark_bytes(benchmark, item_text_col) > most_bytes:
        # Repeated rows and items have one result each.
        got = _joined(docs, benchmark, least, threshold, id_col, text_col, item_col, item_text_col)
        for df, i, t, key, row in ((docs, id_col, text_col, "doc_id", "row"), (benchmark, item_col, item_text_col, "item_id", "item_row")):
            own = _keyed(df, i, t).select(F.col("id").alias("_i"), F.col("row").alias("_r"))
            got = got.join(own, F.col(key).eqNullSafe(F.col("_i")) & (F.col(row) == F.col("_r"))).drop("_i", "_r")
        return got.drop("row", "item_row")
    seeds = docs.sparkSession.sparkContext.broadcast(collect_seeds(benchmark, least, item_col, item_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes")
        hashed = word_hashes()
        for batch in batches:
            for part in pieces_of(batch, 1, SLICE_BYTES):
                rows = list(found(seeds.value, *hashed(part.column(1)), threshold))
                if rows:
                    ids = part.column(0).to_pylist()
                    yield _result([(ids[t], seeds.value.items[k], int(seeds.value.length[k]), c, tiles) for t, k, c, tiles in rows])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, OUT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an item contaminates; null texts stay."""
    small_batches(docs.sparkSession)
    if benchmark_bytes(benchmark, item_text_col) > most_bytes:
        gone = _joined(docs, benchmark, least, threshold, id_col, text_col, item_col, item_text_col).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row1")).distinct()
        same = F.col("_id").cast("long").eqNullSafe(F.col("_gone")) & F.col("_text").isNotNull() & (F.xxhash64("_text") == F.col("_row1"))
        return released(carried(docs, id_col, text_col).join(gone, same, "left_anti"), docs)
    seeds = docs.sparkSession.sparkContext.broadcast(collect_seeds(benchmark, least, item_col, item_text_col))

    @F.arrow_udf("boolean")
    def dirty(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("word hashes")
        hashed = word_hashes()
        for batch in batches:
            out = np.zeros(len(batch), bool)
            at = 0
            for part in pieces_of(pa.record_batch([batch], ["text"]), 0, SLICE_BYTES):
                for text, _, _, _ in found(seeds.value, *hashed(part.column(0)), threshold):
                    out[at + text] = True
                at += part.num_rows
            yield pa.array(out)
        tidy()

    return docs.where(~dirty(F.col(text_col)))


TILES = pa.list_(pa.struct([("item_at", pa.int32()), ("text_at", pa.int32()), ("words", pa.int32())]))


def _result(rows: list[tuple]) -> pa.RecordBatch:
    doc, item, words, covered, tiles = zip(*rows)
    tiles = [[{"item_at": a, "text_at": b, "words": n} for a, b, n in t] for t in tiles]
    share = [c / n for c, n in zip(covered, words)]
    return pa.record_batch(
        [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(words, pa.int32()), pa.array(covered, pa.int32()), pa.array(share), pa.array(tiles, TILES)],
        ["doc_id", "item_id", "words", "covered", "coverage", "tiles"],
    )


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): rows are told apart by their id, which may be null, and their text; null texts have none."""
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _joined(docs, benchmark, least, threshold, id_col, text_col, item_col, item_text_col):
    """Like ``contaminated`` for a benchmark of any size, plus row and item_row, once for equal rows and items.

    Fingerprints of both sides meet in a join, each once a text; the texts of pairs that
    have enough of them are joined again and tiled, a pair a row.
    """

    def prints(most: int | None):
        """``most``: of items, all runs of that many words, or of all words; of documents (None), the distinct runs of 1 to ``least`` words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("word hashes")
            hashed = word_hashes()
            for batch in batches:
                for part in pieces_of(batch, 2, SLICE_BYTES):
                    words, offsets = hashed(part.column(2))
                    lengths = np.diff(offsets)
                    for n in range(1, least + 1):
                        p, t, at = fingerprints(words, offsets, n)
                        if most is None:
                            order = np.lexsort((p, t))
                            p, t, at = p[order], t[order], at[order]
                            keep = np.concatenate(([True], (np.diff(t) != 0) | (p[1:] != p[:-1])))[: len(p)]
                        else:
                            keep = np.minimum(lengths[t], most) == n
                        p, t, at = p[keep], t[keep], at[keep]
                        yield pa.record_batch(
                            [part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), pa.array(np.full(len(t), n, np.int32)), pa.array(p.view(np.int64)), pa.array(lengths[t], pa.int32()), pa.array(at, pa.int32())],
                            ["id", "row", "n", "print", "words", "at"],
                        )

        return run

    schema = "id long, row long, n int, print long, words int, at int"
    sides = {"doc_id": _keyed(docs, id_col, text_col), "item_id": _keyed(benchmark, item_col, item_text_col)}
    seeds = sides["item_id"].mapInArrow(prints(least), schema).select("n", "print", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("words").alias("item_words"), F.col("at").alias("item_at"))
    spots = sides["doc_id"].mapInArrow(prints(None), schema).select("n", "print", F.col("id").alias("doc_id"), "row")
    pairs = (
        spots.join(seeds, ["n", "print"])
        .groupBy("doc_id", "row", "item_id", "item_row")
        .agg(F.first("n").alias("n"), F.first("item_words").alias("words"), F.countDistinct("item_at").alias("seeds"))
        .where(F.col("seeds") * F.col("n") >= F.lit(threshold) * F.col("words"))
    )
    pairs = stash(pairs.select("doc_id", "row", "item_id", "item_row", "n"), "tiling-pairs")
    for key, row, text in (("doc_id", "row", "text"), ("item_id", "item_row", "item_text")):
        own = sides[key].select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.col("text").alias(text))
        same = F.col("_i").eqNullSafe(F.col(f"_{key}")) & (F.col("_r") == F.col(f"_{row}"))
        asked = pairs.select(F.col(key).alias(f"_{key}"), F.col(row).alias(f"_{row}")).distinct()
        own = own.join(asked, same, "left_semi").dropDuplicates(["_i", "_r"])
        sides[key] = own.withColumnsRenamed({"_i": f"_{key}", "_r": f"_{row}"})
    rows = pairs.join(sides["doc_id"], F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("row") == F.col("_row")))
    rows = rows.join(sides["item_id"], F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_row") == F.col("_item_row")))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("word hashes")
        hashed = word_hashes()
        for batch in batches:
            for part in pieces_of(batch, 5, SLICE_BYTES):
                (texts, t), (items, i) = hashed(part.column(5)), hashed(part.column(6))
                out, keys = [], []
                for r, (doc, row, item, item_row, n) in enumerate(zip(*(part.column(c).to_pylist() for c in range(5)))):
                    words = items[i[r] : i[r + 1]]
                    tiles = marked(*all_matches(words, texts[t[r] : t[r + 1]], n), n)
                    covered = sum(x for _, _, x in tiles)
                    if covered >= threshold * len(words):
                        out.append((doc, item, len(words), covered, tiles))
                        keys.append((row, item_row))
                if out:
                    done = _result(out)
                    yield pa.record_batch([*done.columns, *(pa.array(k, pa.int64()) for k in zip(*keys))], [*done.schema.names, "row", "item_row"])

    return rows.select("doc_id", "row", "item_id", "item_row", "n", "text", "item_text").mapInArrow(tile, OUT + ", row long, item_row long")


def op1_benchmark_tiling(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).select("doc_id", "item_id", "words", "covered", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
