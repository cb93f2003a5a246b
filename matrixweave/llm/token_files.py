"""Token-ID output: ids of whole texts as Parquet lists, and selective reads of them.

Rows lie in ascending doc_id order over range-partitioned files.  ``ids`` is a list
column with dictionary encoding, doc_id and n_tokens have delta encoding; row groups
and pages are of a set size and every file has column and page indexes, so a read of
a few documents or of the metadata alone skips the other pages.

Texts are encoded word by word: every pre-token pattern of the tokenizer ends at white
space, so a text's ids are those of its words in order, and each distinct word is
encoded once a worker.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrixweave.llm.common import claim, gathered, memory, new_path, small_batches, tidy

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Bytes of text that are encoded at a time, and distinct words that a worker remembers.
SLICE_BYTES, MOST_WORDS = 16 << 20, 3 << 19
#: Words that are encoded in one call.
AT_ONCE = 1 << 13
LAYOUT = {
    "compression": "snappy",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class Ragged:
    """Values of distinct keys, found again by a key's number."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def rows(self, keys: list[str]) -> np.ndarray:
        """The number of each key; unknown ones are encoded first."""
        new = [k for k in keys if k not in self.number]
        if new and len(self.number) + len(new) > self.most:
            self.clear()
            new = keys
        if new:
            values = self.encode(new)
            lengths = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.fromiter((x for v in values for x in v), np.int32, int(lengths.sum()))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, flat))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        get = self.number.__getitem__
        return np.fromiter(map(get, keys), np.int64, len(keys))

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows one after another, and the offsets of each row among them."""
        lengths = self.lengths[rows]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.starts[rows] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[at], ends


class WordIds:
    """Ids of words by one tokenizer.

    A word of letters, and points or commas after them, is two pre-tokens: its letters
    and its tail.  The letters of many words are encoded as one text; each word ends at
    a token with the tokenizer's mark of word ends.  Other words are encoded alone, and
    so are all if the tokenizer has no such mark.
    """

    TAILS = 64

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if mark:
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(mark)]] = True
        self.marked = bool(mark)
        self.clear()

    def clear(self) -> None:
        #: Words seen, and each one's core and tail: the core's row * TAILS + the tail's number; row 0 has no ids.
        self.known, self.packed = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.cores = pa.array([""], pa.string())
        self.tail: dict[str, int] = {"": 0}
        self.tail_rows = np.zeros(self.TAILS, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int32)

    def _add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)))
        self.lengths = np.concatenate((self.lengths, lengths.astype(np.int32)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each encoded as a text of its own, and how many each has."""
        ids = [np.array(e.ids, np.int32) for a in range(0, len(words), AT_ONCE) for e in self.tokenizer.encode_batch_fast(words[a : a + AT_ONCE], add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters, encoded as one text."""
        parts = []
        for a in range(0, len(words), AT_ONCE):
            some = words[a : a + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            parts.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(some) else self._alone(some))
        return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _tail(self, tail: str) -> int:
        """The number of a tail, -1 if there are too many."""
        if tail not in self.tail:
            if len(self.tail) == self.TAILS:
                return -1
            self.tail_rows[len(self.tail)] = len(self.lengths)
            self.tail[tail] = len(self.tail)
            self._add(*self._alone([tail]))
            self.cores = pa.concat_arrays([self.cores, pa.array([None], pa.string())])  # rows and cores keep step
        return self.tail[tail]

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The numbers of new words."""
        core = pc.utf8_rtrim(words, characters=".,")
        simple = np.asarray(pc.and_(pc.utf8_is_alpha(core), pc.string_is_ascii(core)).cast(pa.int8())).astype(bool)
        other = np.flatnonzero(~simple & np.asarray(pc.utf8_is_alpha(core).cast(pa.int8())).astype(bool))
        for i, c in zip(other.tolist(), core.take(pa.array(other)).to_pylist()):
            simple[i] = c.lower().isalpha() and is_normalized("NFC", c)
        if not self.marked:
            simple[:] = False
        cut = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(core))
        number = np.zeros(len(words), np.int64)
        rows = np.flatnonzero(simple & (cut > 0))
        tails = [w[-n:] for w, n in zip(words.take(pa.array(rows)).to_pylist(), cut[rows].tolist())]
        found = {t: self._tail(t) for t in set(tails)}
        number[rows] = np.fromiter(map(found.__getitem__, tails), np.int64, len(tails))
        simple[number < 0] = False
        number = np.maximum(number, 0) * simple
        coded = pc.if_else(pa.array(simple), core, words).dictionary_encode()
        codes, distinct = np.asarray(coded.indices), coded.dictionary
        of_letters = np.zeros(len(distinct), bool)
        of_letters[codes[simple]] = True
        row = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.cores), -1)).astype(np.int64)
        for letters in (True, False):
            new = np.flatnonzero((row < 0) & (of_letters == letters))
            values = distinct.take(pa.array(new))
            row[new] = len(self.lengths) + np.arange(len(new))
            self._add(*(self._letters if letters else self._alone)(values.to_pylist()))
            self.cores = pa.concat_arrays([self.cores, values])
        return row[codes] * self.TAILS + number

    def __call__(self, distinct: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words ``distinct[codes]`` one after another, and the offsets by word."""
        at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1)).astype(np.int64)
        if (at < 0).any() and len(self.known) + len(at) > self.most:
            self.clear()
            at[:] = -1
        new = np.flatnonzero(at < 0)
        if len(new):
            words = distinct.take(pa.array(new))
            at[new] = len(self.known) + np.arange(len(new))
            self.packed = np.concatenate((self.packed, self._learn(words)))
            self.known = pa.concat_arrays([self.known, words])
        packed = self.packed[at]
        rows = np.stack((packed // self.TAILS, self.tail_rows[packed % self.TAILS]), axis=1).astype(np.int32)[codes].reshape(-1)
        lengths = self.lengths[rows]
        ends = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(lengths, out=ends[1:])
        spot = np.repeat(self.starts[rows] - ends[:-1], lengths)
        spot += np.arange(ends[-1], dtype=np.int32)
        return self.flat[spot], ends[::2]


@functools.lru_cache(1)
def _words(path: str) -> WordIds:
    """The tokenizer's ids of distinct words; a Python worker keeps them from task to task."""
    return WordIds(path)


memory("words", _words.cache_clear)


def encode_texts(text: pa.Array, words: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's followed by ``end_id``, and the offsets by text."""
    text = pc.fill_null(text, "")
    if not pc.any(pc.match_substring(text, "<|")).as_py():
        text = pc.ascii_lower(text)  # the tokenizer lower-cases all but its special tokens
    lists = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    offsets -= offsets[0]
    ids, ends = words(coded.dictionary, np.asarray(coded.indices))
    bounds = ends[offsets].astype(np.int64)
    return np.insert(ids, bounds[1:], end_id).astype(np.int32), bounds + np.arange(len(bounds))


def token_rows(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens) of each row; a null text is empty and has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        words = _words(path)
        for part in gathered(batches, 1, SLICE_BYTES):
            ids, bounds = encode_texts(part.column(1), words, end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([part.column(0), lists, pa.array(np.diff(bounds), pa.int64())], ["doc_id", "ids", "n_tokens"])
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token files of ``docs``; rows with one doc_id lie in the order of their texts, nulls come first."""
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    token_rows(rows, path, end_id).write.options(**LAYOUT).parquet(out)
    return out


def read_tokens(spark: SparkSession, out: str, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows with low <= doc_id < high of token files; only the columns named and the pages needed are read."""
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long").parquet(out)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    return rows.select(*columns) if columns else rows


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from token files; start counts all ids in earlier rows.

    Only lengths are shuffled.  Rows are summed within their file, and one row a file
    is summed over all files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            raw = np.asarray(lists.values).astype("<u4", copy=False)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    rows = read_tokens(spark, out).select("doc_id", "ids", F.expr("cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file long, row long")
    files = read_tokens(spark, out).select("n_tokens", F.expr("cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as long)").alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file").alias("_file"), before.alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside)
    return rows.join(files, rows.file == files._file).select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = write_tokens(docs, new_path(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return token_digests(spark, out)
