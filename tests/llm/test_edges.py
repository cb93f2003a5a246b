"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from matrixweave.llm import language_id, line_dedup, near_copies, secret_scan, sentence_pieces, simhash, span_dedup, string_tiling, suffix_dedup, token_files, vantage_trees
from matrixweave.llm.common import connected_components, new_path

LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (1, "One line that repeats here.\nAnother line, short.\n\nLast", "en"),
    (2, "one line that repeats here.  \nOther text of the second.", "en"),
    (2, "one line that repeats here.  \nOther text of the second.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n ", "de"),
    (None, "One line that repeats here.", "en"),
    (6, LONG, "en"),
    (7, LONG + " tail", None),
    (8, "12345 !!! 678", "fr"),
    (9, "é" * 700, "fr"),
    (10, "nul \x00 byte and \U0001f600 and ▁ marker", None),
]
#: Names that the operators use inside.
CLASH = ["doc", "row", "pos", "key", "h1", "h2", "spans", "_row", "_id", "_doc", "_kept", "ids", "data", "node", "group", "component", "fp", "rank", "score", "tiles"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "word5x5 word6x6 word7x7 word8x8 word9x9"), (2, None), (3, ""), (4, "line that repeats"), (None, "no id here but words")], "item_id long, text string")


def model_path(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


def test_lines(docs, empty):
    out = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(out) == len(set(ROWS))
    assert out[1, ROWS[0][1]]._n_dropped == 0
    assert out[2, ROWS[1][1]]._kept == "Other text of the second."
    assert (out[3, None]._n_lines, out[3, None]._kept) == (1, "")
    assert out[None, ROWS[6][1]]._n_dropped == 0
    assert line_dedup.dedup_lines(docs).where("doc_id = 2").count() == 2
    assert line_dedup.dedup_lines(docs).select("key").distinct().first()[0] == "own key"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_spans(docs, empty):
    out = span_dedup.dedup_spans(docs, k=2, min_chars=10)
    assert out.count() == len(ROWS)
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[3]._n_sentences == 0 and got[3]._kept == ""
    assert got[6]._kept == LONG
    assert span_dedup.dedup_spans(empty).count() == 0


def test_languages(docs, empty):
    model = language_id.fit(docs)
    found = docs.select("doc_id", language_id.predictor(docs, model)("text").alias("p")).collect()
    assert {r.doc_id for r in found if r.p.lang == "und"} == {3, 4, 5, 8}
    assert all(0 <= r.p.score <= 1 for r in found)
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    nothing = language_id.fit(empty)
    assert nothing.langs == []
    assert {r[0] for r in docs.select(language_id.predictor(docs, nothing)("text").lang).collect()} == {"und"}
    assert language_id.keep_known(empty, model).count() == 0


def test_simhash(docs, empty):
    prints = simhash.fingerprints64(docs)
    out = {r.doc_id: r for r in simhash.components2(prints).where("doc_id is not null").collect()}
    assert out[3].fp == out[4].fp == out[5].fp == 0
    assert out[3].component_id == out[4].component_id == out[5].component_id == 3
    assert out[6].component_id == out[7].component_id == 6
    assert simhash.components2(prints).count() == len(ROWS)
    assert simhash.components2(simhash.fingerprints64(empty)).count() == 0


def test_near_copies(docs, empty):
    groups = {r.doc: r.group for r in near_copies.near_groups(docs).collect()}
    assert groups[7] == 6 and groups[4] == groups[5] == 3
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    assert near_copies.keep_one(empty).count() == 0


def test_tiling_judges_each_row_at_any_size(spark):
    item = "one two three four five six seven eight"
    rows = [(None, item), (None, "nothing of it"), (1, item), (1, "a clean row of one document"), (2, item), (2, item), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    for most in (1 << 20, 0):
        clean = string_tiling.decontaminate(docs, bench, most_bytes=most).collect()
        assert sorted(map(tuple, clean), key=str) == [(1, rows[3][1]), (3, None), (None, rows[1][1])]
        found = string_tiling.contaminated(docs, bench, most_bytes=most).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted(((d, i) for d in (None, 1, 2, 2) for i in (5, 5, None)), key=str)


def test_tiling(docs, empty, benchmark):
    want = {(6, 1), (7, 1)}
    for most in (1 << 20, 0):
        rows = string_tiling.contaminated(docs, benchmark, most_bytes=most).collect()
        got = {(r.doc_id, r.item_id) for r in rows}
        assert want <= got
        assert {(1, 4), (2, 4), (None, 4)} <= got  # an item of fewer words than a seed must be whole
        clean = string_tiling.decontaminate(docs, benchmark, most_bytes=most)
        assert clean.columns == docs.columns
        assert {3, 4, 5, 8, 9, 10} == {r.doc_id for r in clean.where("doc_id is not null").collect()}
        assert string_tiling.contaminated(empty, benchmark, most_bytes=most).count() == 0
        assert string_tiling.contaminated(docs, benchmark.limit(0), most_bytes=most - 1).count() == 0


def test_tokens(spark, docs, empty):
    path = model_path("word_bpe_49k.json")
    out = token_files.write_tokens(docs, new_path(spark, "test"), path)
    rows = token_files.token_digests(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert token_files.read_tokens(spark, out, ["doc_id"], 4, 7).count() == 3
    out = token_files.write_tokens(empty, new_path(spark, "test"), path)
    assert token_files.token_digests(spark, out).count() == 0


def test_pieces(docs, empty):
    path = model_path("piece_bpe_32k.model")
    rows = sentence_pieces.round_trip(docs, path).collect()
    assert len(rows) == len(ROWS) and all(r.exact for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    assert sentence_pieces.round_trip(empty, path).count() == 0


def test_suffixes(docs, empty):
    rows = suffix_dedup.dedup_substrings(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert (by[3].n_bytes, by[3].n_removed) == (0, 0)
    assert by[6].n_removed == by[6].n_bytes and by[7].n_removed == by[6].n_bytes
    assert by[9].n_removed == 1400 and by[9].n_spans == 1
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_secrets(spark, empty):
    texts = [None, "", 'x password = "abc12" token:abcdefgh', "AKIA" + "A1" * 8 + " " + "0123456789abcdef01234567", "ApI_KeY=é", LONG, 'secret is Zk3x9QpL2vB7wRtY5mN8 here']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.secret_spans(df).collect()}
    assert got[0] == got[1] == got[4] == got[5] == []
    assert got[2] == [("assign", 21, 35)]
    assert got[3] == [("access", 0, 20), ("hex", 21, 45)]
    assert got[6] == [("novel", 10, 30)]
    assert secret_scan.secret_spans(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("shard", F.lit(1))
    got = {}
    for r in vantage_trees.nearest(df, df.where("vec_id in (0, 4)"), k=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 1, 1.0), (2, 2, 1.0)]}
    none = df.limit(0)
    assert vantage_trees.nearest(none, none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (7, 8), (2, 2), (None, 1)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 7: 7, 8: 7}


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
