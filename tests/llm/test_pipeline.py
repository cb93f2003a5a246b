"""The stages of the pipeline against plain programs, and on odd rows."""

import collections
import itertools
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from matrixweave.llm import language_id, near_copies, string_tiling  # noqa: E402

COLUMNS = corpus_pipeline.COLUMNS


def words_of(text):
    out = ["".join(filter(str.isalnum, w.lower())) for w in re.split(r"[\x20\x09-\x0D]+", text or "")]
    return [w for w in out if w]


def copies(rows):
    """The smallest doc_id of each document's group of near copies, from all pairs that share a shingle."""
    sets, parent = {}, {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        shared.update(itertools.combinations(sorted(own), 2))
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_copies_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc: r.group for r in near_copies.near_groups(docs).collect()}
    want = copies([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and len(set(want.values())) < len(want)


def test_all_stages_against_plain_ones(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    got = [docs]
    for _, stage in corpus_pipeline.STAGES:
        got.append(stage(spark, got[-1], sf).cache())
    plain = lambda df: sorted(map(tuple, df.collect()))

    model = language_id.fit(docs)
    langs, _, rate = model.predict([r[1] for r in rows], language_id.symbol_table(model.letters))
    rows = [r for r, x, n in zip(rows, langs, rate) if x != "und" and n <= 0.5]
    assert plain(got[1]) == sorted(rows)

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first, out = {}, []
    for r in sorted(rows):
        for x in r[1].split("\n"):
            first.setdefault(key(x), r[0])
    for r in rows:
        kept = [x for x in r[1].split("\n") if len(key(x)) < 10 or first[key(x)] == r[0]]
        text = "\n".join(kept)
        out.append((*(r[:1]), text, *r[2:4], r[4] if text == r[1] else len(text)))
    rows = out
    assert plain(got[2]) == sorted(rows)

    groups = copies([r[:2] for r in rows])
    rows = [r for r in rows if groups[r[0]] == r[0]]
    assert plain(got[3]) == sorted(rows)

    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := words_of(r.text))]

    def dirty(text):
        words = words_of(text)
        for item in items:
            n = min(4, len(item))
            places = collections.defaultdict(list)
            for b in range(len(words) - n + 1):
                places[tuple(words[b : b + n])].append(b)
            pairs = [(a, b) for a in range(len(item) - n + 1) for b in places.get(tuple(item[a : a + n]), [])]
            if pairs and sum(t[2] for t in string_tiling.greedy_tiles(*map(np.array, zip(*pairs)), n)) >= 0.6 * len(item):
                return True
        return False

    rows = [r for r in rows if not dirty(r[1])]
    assert plain(got[4]) == sorted(rows)
    last = got[5].collect()
    assert sorted(r.doc_id for r in last) == sorted(r[0] for r in rows) and all(r.exact for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r[0] for r in rows)


def test_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    text = "A line of English words that is long enough.\nAnd a second line of other words here, which nobody else has."
    rows = [
        (1, text, "en", "a", 7), (2, text.upper() + "\nthird line, which is also long", None, None, None), (2, text.upper() + "\nthird line, which is also long", None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t", None, "b", 3), (None, text, "en", "a", 9), (6, "12 34 !", "en", "a", 7), (7, "word " * 50_000, "en", "c", 250_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as _text", "2 as _row", "3 as key")
    kept = {name: f(spark, docs, sf) for name, f in corpus_pipeline.STAGES}
    ids = {name: sorted((r.doc_id for r in df.collect()), key=str) for name, df in kept.items()}
    every = sorted((r[0] for r in rows), key=str)
    assert all(df.columns == COLUMNS for name, df in kept.items() if name != "sentence pieces")
    assert not {3, 4, 5, 6} & set(ids["language ID"]) and {1, 2, 7, None} <= set(ids["language ID"])
    assert ids["line dedup"] == ids["decontamination"] == ids["sentence pieces"] == every
    lines = {r.doc_id: r for r in kept["line dedup"].collect()}
    assert (lines[2].text, lines[2].n_chars, lines[1].n_chars, lines[None].n_chars, lines[3].text) == ("third line, which is also long", 30, 7, 9, None)
    # Texts without words are copies of each other; the smallest stays, and a null doc_id does.
    assert ids["near copies"] == sorted([1, 2, 2, 3, 6, 7, None], key=str)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0, name


def test_links_of_simhash_are_looked_up_and_checked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = [f"w{k}" for k in rng.integers(0, 5000, 3000)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, " ".join(text[::-1])), (4, None)], "doc_id long, text string")
    own = docs.selectExpr("doc_id as doc", "doc_id as node")
    of = lambda share: [tuple(r) for r in near_copies.simhash_links(docs, own, 5, share, "doc_id", "text").collect()]
    assert of(0.8) == [(1, 2)] and of(1.0) == []
    # The stage has them where the lookup of values finds nothing.
    monkeypatch.setattr(near_copies, "links_at_values", lambda sure: lambda batches: (b for b in ()))
    assert {r.doc: r.group for r in near_copies.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
