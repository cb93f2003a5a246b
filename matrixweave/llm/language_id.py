"""Language ID by cross-parsing entropy.

A suffix automaton of each language's training text gives, at every place of a text,
the longest phrase that also occurs in that language.  Parsing a text greedily into
such phrases, the language that needs fewest wins; counts are normalised by the text's
length and the bits that name a place of the training text, log2 of its size.

Texts are parsed as symbols: letters in lower case, runs of anything else as one space,
letters that training has not seen often as one symbol.  They are parsed in blocks of
``BLOCK`` symbols, a phrase ends with its block, and all blocks of a slice take each
step at once through one table of all automata.  Whole texts are parsed.

The model is fitted on a bounded sample: of each language ``SAMPLE_DOCS`` rows at most,
``DOC_CHARS`` characters of each and ``LANG_CHARS`` in all (less if very many languages
share ``ALL_CHARS``).  They come from the ``SAMPLE_DOCS`` documents of smallest hash of
doc_id: a row of each, then a second row of those whose doc_id has several texts, and so
on.  Rows without doc_id or lang, without a letter in their text, and held-out rows are
not learnt from and take no place of the sample.  Equal counts go to the first language
by name.

The table of all automata is dense while it has at most ``DENSE`` places, and else holds
the transitions that there are, in order; both lead to the same phrases.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.llm.common import carried, claim, released, small_batches, tidy

SAMPLE_DOCS, DOC_CHARS, LANG_CHARS, ALL_CHARS = 256, 400, 32_000, 1_500_000
DENSE = 1 << 25
BLOCK = 1024
SLICE_CHARS = 2 << 20
#: Letters that get a symbol of their own.
LETTERS = 200
UNKNOWN = "und"
SPACE, RARE, FIRST = 0, 1, 2
NEW = 1 << 30
#: A text whose mean phrase is shorter than two symbols is in none of the languages.
MOST_PHRASES = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@functools.lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(2)
def symbol_table(letters: str) -> np.ndarray:
    """The symbol of each code point."""
    out = np.where(_is_letter(), np.uint8(RARE), np.uint8(SPACE))
    for i, c in enumerate(letters):
        out[ord(c)] = FIRST + i
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of lower-case texts one after another, and the offsets by text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    found = table[_codes("".join(texts))]
    keep = np.ones(len(found), bool)
    space = found == SPACE
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][lengths > 0]] = True
    return found[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton of all substrings of ``text``; state 0 is its root."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
        last = new
    return after


class Model:
    """Automata of all languages in one table: place s + c holds the row that symbol c leads to from row s, with NEW if a phrase begins at c.

    ``next`` is that table, or empty if it were larger than ``dense``.  Then ``keys``
    holds, in order, the places whose transition is not the root's, and ``values`` what
    they hold; all other places hold what the root's row does.
    """

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        self.langs = sorted(samples)
        lower = {k: v.lower() for k, v in samples.items()}
        letters = Counter(c for v in lower.values() for c in v if c.isalpha())
        own = sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS]
        self.letters = "".join(own)
        table = symbol_table(self.letters)
        self.wide = FIRST + len(own)
        places, targets, self.starts, self.roots, self.bits, at = [], [], [], [], [], 0
        for lang in self.langs:
            found, _ = symbols([lower[lang]], table)
            after = suffix_automaton(found.tolist())
            root = np.full(self.wide, at | NEW, np.int32)
            for c, s in after[0].items():
                root[c] = (at + s * self.wide) | NEW
            pairs = [(at + s * self.wide + c, at + t * self.wide) for s, kids in enumerate(after[1:], 1) for c, t in sorted(kids.items())]
            places.append(np.array([x for x, _ in pairs], np.int32))
            targets.append(np.array([x for _, x in pairs], np.int32))
            self.starts.append(root)
            self.roots.append(at)
            self.bits.append(float(np.log2(max(2, len(found)))))
            at += len(after) * self.wide
        none = np.zeros(0, np.int32)
        self.keys, self.values = (np.concatenate([none, *x]) for x in (places, targets))
        self.next = none
        if at <= dense:
            sizes = np.diff([*self.roots, at])
            self.next = np.concatenate([none, *(np.tile(r, n // self.wide) for r, n in zip(self.starts, sizes))])
            self.next[self.keys] = self.values
            self.keys = self.values = none

    def step(self, lang: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What the places of ``symbol`` in the rows ``state`` of one language hold."""
        if len(self.next):
            return self.next[state + symbol]
        place = state + symbol
        at = np.minimum(np.searchsorted(self.keys, place), len(self.keys) - 1)
        return np.where(self.keys[at] == place, self.values[at], self.starts[lang][symbol])

    def phrases(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language: texts x languages."""
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(lengths)), blocks)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = offsets[text] + inner * BLOCK
        sizes = np.minimum(BLOCK, offsets[text + 1] - starts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        out = np.zeros((len(lengths), len(self.langs)), np.int64)
        if not len(starts) or not self.langs:
            return out
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        for k, root in enumerate(self.roots):
            state = np.full(len(starts), root, np.int32)
            count = np.zeros(len(starts), np.int64)
            for t, n in enumerate(active.tolist()):
                v = self.step(k, state[:n], found[starts[:n] + t])
                count[:n] += v >> 30
                state[:n] = v & (NEW - 1)
            np.add.at(out[:, k], text[order], count)
        return out

    def predict(self, texts: list[str | None], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, phrases a symbol) of each text.

        score: 1 - (best / second best) of the normalised counts; 1 with one language.
        ``und``, score 0 and rate 1 for null texts and those without a letter.
        """
        lower = [(t or "").lower() for t in texts]
        found, offsets = symbols(lower, table)
        letters = np.concatenate(([0], np.cumsum(found > SPACE)))[offsets]
        known = np.diff(letters) > 0
        size = np.maximum(np.diff(offsets), 1)
        counts = self.phrases(found, offsets)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        cost = counts * np.array(self.bits) / size[:, None]
        best = cost.argmin(axis=1)
        rows = np.arange(len(texts))
        low = cost[rows, best]
        cost[rows, best] = np.inf
        second = cost.min(axis=1)
        score = np.where(known, 1 - low / np.maximum(second, 1e-12), 0).clip(0, 1)
        rate = np.where(known, counts[rows, best] / size, 1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], score, rate


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled rows that are not held out; only a bounded sample reaches the driver."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("doc").isNotNull() & ~held_out(F.col("doc")) & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.approx_count_distinct("doc").alias("n")).collect()}  # a row a language, as the model has
    if not counts:
        return Model({})
    # Hashes are even, so about four times the documents wanted lie under this share of them; only these are ranked.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 4.0 * SAMPLE_DOCS / max(1, n))])
    ids = own.select("lang", "doc", F.xxhash64("doc").alias("h")).where(F.col("h").cast("double") / float(1 << 64) + 0.5 < F.element_at(share, F.col("lang"))).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc"))
    ids = ids.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).drop("rank")
    # Of a doc_id with very many rows, each task hands on no more than the sample holds.
    rows = own.join(F.broadcast(ids), ["lang", "doc"]).select("lang", "h", "doc", F.xxhash64("text").alias("t"), F.substring("text", 1, DOC_CHARS).alias("text")).distinct()
    turn = F.row_number().over(Window.partitionBy("lang", "doc").orderBy("t", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "h", "doc"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= SAMPLE_DOCS).withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.place)):
        texts.setdefault(r.lang, []).append(r.text)
    most = min(LANG_CHARS, ALL_CHARS // max(1, len(texts)))
    return Model({k: "\n".join(v)[:most] for k, v in texts.items()})


RESULT = "struct<lang:string,score:double,rate:double>"


def predictor(docs: DataFrame, model: Model):
    """A column function: text -> struct(lang, score, rate)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim()
        own = shared.value
        tidy()
        table = symbol_table(own.letters)
        for batch in batches:
            texts, done = batch.to_pylist(), []
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                done.append(own.predict(texts[at:end], table))
                at = end
            langs = [x for d in done for x in d[0]]
            score, rate = (np.concatenate([d[k] for d in done]) if done else np.zeros(0) for k in (1, 2))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], ["lang", "score", "rate"])
        tidy()

    return predict


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", most_phrases: float = MOST_PHRASES) -> DataFrame:
    """``docs`` without the rows that the model rejects: no letter, or phrases too short to be any learned language."""
    found = carried(docs, text_col, text_col).withColumn("_language", predictor(docs, model)(F.col("_text")))
    return released(found.where((F.col("_language.lang") != UNKNOWN) & (F.col("_language.rate") <= most_phrases)), docs)


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = docs.withColumn("found", predictor(docs, fit(docs))(F.col("text")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
