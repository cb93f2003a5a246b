"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space is marked as in SentencePiece: a text gets a leading space, and each space
is a marker that pieces may hold.  A piece holds markers only at its start, so the best
path of a text is that of its segments (a run of markers and the word after it), and
each distinct segment is searched once a worker, many segments in step.  A character
that no piece of one character covers costs the lowest score less ten and becomes its
UTF-8 bytes' pieces.  Inside the trie a marker is byte 0xFF, which UTF-8 never holds;
so U+2581 in a text is no marker, and decoding always gives the text back.

The public vocabulary at hand has merge ranks for scores.  They become log scores by
Zipf's law: ln(1 / (rank + 1)), less the log of the sum over all ranks.

Null and empty texts have no ids.  Of equally good paths, the one of the longer last
piece wins.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import claim, gathered, memory, small_batches, tidy
from matrixweave.llm.token_files import Ragged

MODEL = "piece_bpe_32k.model"
SLICE_BYTES = 8 << 20
#: Bytes beyond which a segment is searched by itself.
LONG = 48
#: Segments that are searched in step.
AT_ONCE = 1 << 14
#: Distinct segments that a worker remembers.
MOST_SEGMENTS = 1 << 18
#: SentencePiece's piece types, model types and penalty: fixed values.
NORMAL, BYTE, USER = 1, 6, 4
RANKED = 2
UNKNOWN_PENALTY = 10.0
MARKER, MARKER_BYTE = "▁".encode(), b"\xff"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, log scores and the double-array trie of one model file."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], ranked: bool):
        self.size = len(pieces)
        scores = np.array([s for _, s, _ in pieces], np.float64)
        if ranked:
            rank = np.where((scores > -1e8) & (scores <= 0), -scores, self.size)
            scores = -np.log(rank + 1) - np.log((1 / np.arange(1, self.size + 1)).sum())
        own = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.scores = scores
        self.unknown = float(scores[own].min()) - UNKNOWN_PENALTY if own else -UNKNOWN_PENALTY
        self.byte_id = np.full(256, -1, np.int32)
        #: What each piece stands for in a decoded text.
        self.surface: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
            self.surface.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(MARKER, b" ") if kind in (NORMAL, USER) else b"")
        self.is_byte = np.isin(np.arange(self.size), self.byte_id)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        keys = {pieces[i][0].replace(MARKER, MARKER_BYTE): i for i in reversed(own)}
        if any(MARKER_BYTE in k.lstrip(MARKER_BYTE) for k in keys):
            raise ValueError("a piece holds a marker after other characters")
        self._build(keys)

    def _build(self, keys: dict[bytes, int]) -> None:
        """Double array: the child of state s by byte c is t = base[s] + c, if check[t] == s."""
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, i in keys.items():
            node = 0
            for c in key:
                after = children[node].get(c)
                if after is None:
                    after = children[node][c] = len(children)
                    children.append({})
                node = after
            ends[node] = i
        room = 2 * len(children) + 1024
        base, check, value = [0] * room, [-1] * room, [-1] * room
        check[0] = 0
        first, place, queue = 1, {0: 0}, [0]
        for node in queue:
            state = place[node]
            value[state] = ends.get(node, -1)
            kids = children[node]
            if not kids:
                continue
            low, at, tried = min(kids), first, 0
            while at < low or any(check[at - low + c] >= 0 for c in kids):
                at, tried = at + 1, tried + 1
                if at + 512 > len(check):
                    base += [0] * room
                    check += [-1] * room
                    value += [-1] * room
            if tried > 256:  # what lies before is nearly full
                first = at
            base[state] = at - low
            for c, kid in kids.items():
                check[at - low + c] = state
                place[kid] = at - low + c
                queue.append(kid)
        size = max(place.values()) + 513
        self.base, self.check, self.value = (np.array((x + [y] * 513)[:size], np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))
        self.deepest = max(map(len, keys), default=0)

    def encode_segments(self, keys: list[str]) -> list[list[int]]:
        """Ids of segments; a key is a segment without its first marker, other markers as spaces."""
        if len(keys) > AT_ONCE:
            return [v for a in range(0, len(keys), AT_ONCE) for v in self.encode_segments(keys[a : a + AT_ONCE])]
        raw = [(b" " + k.encode()).replace(b" ", MARKER_BYTE) for k in keys]
        out: list[list[int]] = [[]] * len(raw)
        by: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by.setdefault(-(-len(r) // 4) if len(r) <= LONG else 0, []).append(i)
        for k, rows in by.items():
            found = map(self._alone, (raw[i] for i in rows)) if k == 0 else self._together([raw[i] for i in rows], 4 * k)
            for i, ids in zip(rows, found):
                out[i] = ids
        return out

    def _together(self, raw: list[bytes], wide: int) -> list[list[int]]:
        """Viterbi over many short segments: all of them take each step at once."""
        n = len(raw)
        text = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raw), np.uint8).reshape(n, wide)
        length = np.fromiter(map(len, raw), np.int64, n)
        best = np.full((n, wide + 4), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, wide + 4), np.int32)
        used = np.full((n, wide + 4), -1, np.int32)
        lead = (text & 0xC0) != 0x80
        span = np.select([text < 0x80, text == 0xFF, text >= 0xF0, text >= 0xE0], [1, 1, 4, 3], 2)
        for s in range(wide):
            rows = np.flatnonzero((s < length) & lead[:, s])
            if not len(rows):
                continue
            start = best[rows, s]
            one = span[rows, s]
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for d in range(1, min(self.deepest, wide - s) + 1):
                after = self.base[state] + text[rows[live], s + d - 1]
                ok = (self.check[after] == state) & (s + d <= length[rows[live]])
                live, state = live[ok], after[ok].astype(np.int64)
                if not len(live):
                    break
                piece = self.value[state]
                hit = piece >= 0
                at, ids = live[hit], piece[hit]
                single[at[one[at] == d]] = True
                score = start[at] + self.scores[ids]
                better = score > best[rows[at], s + d]
                at, r = at[better], rows[at[better]]
                best[r, s + d], back[r, s + d], used[r, s + d] = score[better], s, ids[better]
            for d in range(1, 5):
                at = np.flatnonzero(~single & (one == d))
                score = start[at] + self.unknown
                better = score > best[rows[at], s + d]
                r = rows[at[better]]
                best[r, s + d], back[r, s + d], used[r, s + d] = score[better], s, -1
        return [self._path(r, b, u) for r, b, u in zip(raw, back.tolist(), used.tolist())]

    def _path(self, raw: bytes, back: list[int], used: list[int]) -> list[int]:
        ids: list[int] = []
        at = len(raw)
        while at:
            s, i = back[at], used[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [int(self.byte_id[c]) for c in reversed(raw[s:at])]
            at = s
        return ids[::-1]

    @functools.cached_property
    def _lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        return self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist()

    def _alone(self, raw: bytes) -> list[int]:
        """Viterbi over one long segment."""
        base, check, value, scores = self._lists
        n = len(raw)
        best, back, used = [-np.inf] * (n + 5), [0] * (n + 5), [-1] * (n + 5)
        best[0] = 0.0
        s = 0
        while s < n:
            c = raw[s]
            one = 1 if c < 0x80 or c == 0xFF else 4 if c >= 0xF0 else 3 if c >= 0xE0 else 2
            start, state, single = best[s], 0, False
            for at in range(s, n):
                after = base[state] + raw[at]
                if check[after] != state:
                    break
                state = after
                i = value[state]
                if i >= 0:
                    single |= at + 1 - s == one
                    if start + scores[i] > best[at + 1]:
                        best[at + 1], back[at + 1], used[at + 1] = start + scores[i], s, i
            if not single and start + self.unknown > best[s + one]:
                best[s + one], back[s + one], used[s + one] = start + self.unknown, s, -1
            s += one
        return self._path(raw, back, used)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 of each list of ids, without the space that encoding put before the text."""
        taken = self._surfaces.take(pa.array(ids, pa.int32()))
        cuts = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[bounds].tolist() if len(taken) else [0] * len(bounds)
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a:b])[1:] if data[a : a + 1] == b" " else bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    @functools.cached_property
    def _surfaces(self) -> pa.Array:
        return pa.array(self.surface, pa.binary())


@functools.lru_cache(2)
def load(path: str) -> Model:
    """The model of a SentencePiece file with byte fallback."""
    pieces, ranked = [], False
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1], float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
            elif number == 2:
                ranked = dict(_fields(value)).get(3) == RANKED
    return Model(pieces, ranked)


@functools.lru_cache(1)
def _segments(path: str) -> Ragged:
    """Ids of distinct segments; a Python worker keeps them from task to task."""
    return Ragged(load(path).encode_segments, MOST_SEGMENTS)


memory("segments", _segments.cache_clear)


def encode_texts(text: pa.Array, words: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and the offsets by text; null and empty texts have none."""
    text = pc.fill_null(text, "")
    odd = np.asarray(pc.or_(pc.or_(pc.match_substring(text, "  "), pc.starts_with(text, " ")), pc.ends_with(text, " ")).cast(pa.int8())).astype(bool)
    if odd.any():
        lists = pa.array([[s[1:] for s in re.findall(" +[^ ]*", " " + t)] if o else t.split(" ") for t, o in zip(text.to_pylist(), odd)], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(text, " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    offsets -= offsets[0]
    rows = words.rows(coded.dictionary.to_pylist())
    ids, ends = words.spread(rows[np.asarray(coded.indices)])
    bounds = ends[offsets]
    empty = np.asarray(pc.binary_length(text)) == 0
    if empty.any():
        ids = ids[~np.repeat(empty, np.diff(bounds))]
        bounds = np.concatenate(([0], np.cumsum(np.where(empty, 0, np.diff(bounds)))))
    return ids, bounds


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) of each row of ``docs``; other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("segments")
        words = _segments(path)
        for part in gathered(batches, 1, SLICE_BYTES):
            ids, bounds = encode_texts(part.column(1), words)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([part.column(0), part.column(1), lists], ["doc_id", "text", "ids"])
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def _counts(model: Model, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """n_pieces, n_fallback and ids_crc32 of each list of ids."""
    raw = ids.astype("<u4", copy=False)
    sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    back = np.concatenate(([0], np.cumsum(model.is_byte[ids])))[bounds]
    return [pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(back), pa.int64()), pa.array(sums, pa.int64())]


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows(doc_id, text, ids)`` plus decoded, n_pieces, n_fallback and ids_crc32; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            ids = np.asarray(pc.list_flatten(lists)).astype(np.int32, copy=False)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            texts = [t.decode("utf-8", "replace") for t in model.decode(ids, bounds)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string()), *_counts(model, ids, bounds)], [*batch.schema.names, "decoded", "n_pieces", "n_fallback", "ids_crc32"])
        tidy()

    return rows.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string, n_pieces long, n_fallback long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_fallback, ids_crc32, decoded_sha256, exact) of each row; exact: decoding gave the text back."""
    names = ["doc_id", "n_pieces", "n_fallback", "ids_crc32", "decoded_sha256", "exact"]

    # As decode(encode(docs)), with one Python worker a task instead of two.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("segments")
        words, model = _segments(path), load(path)
        for part in gathered(batches, 1, SLICE_BYTES):
            ids, bounds = encode_texts(part.column(1), words)
            texts = model.decode(ids, bounds)
            own = [(t or "").encode() for t in part.column(1).to_pylist()]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.record_batch([part.column(0), *_counts(model, ids, bounds), pa.array(digests), pa.array([a == b for a, b in zip(texts, own)])], names)
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, decoded_sha256 string, exact boolean")


def op2_sentence_pieces(spark, sf_dir):
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
