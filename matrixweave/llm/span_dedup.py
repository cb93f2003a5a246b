"""Substring dedup by sliding sentence spans.

A sentence ends after a run of ``. ! ?`` and newlines and the blanks that follow; the
pieces joined give the text back.  From every sentence the shortest run of at least
``k`` consecutive sentences whose keys have at least ``min_chars`` code points together
is hashed, so a passage of short sentences has longer runs, and hashes meet globally.
Each sentence that a non-first repeated run covers is removed; the first run is the one
of the smallest doc_id, and of the smallest position in it.  Where a text ends before a
run has ``min_chars``, there is none.

Repeats within a text are found in the text itself.  Between texts, the smallest and
largest doc_id of each hash are pre-aggregated before the shuffle and joined back to
the runs, a skewed join that Spark splits where very many texts share a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixweave.llm.common import carried, released, stash, unstash
from matrixweave.llm.line_dedup import WORD, line_key, row_key

K, MIN_CHARS = 2, 50
SENTENCE = r"[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+"


def split_sentences(text: Column) -> Column:
    """The sentences of a text; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def sentence_runs(docs: DataFrame, k: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, pos, n, h1, h2) of the run that starts at each sentence: its first sentence, its sentences and its hashes."""
    keys = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row"), F.transform(split_sentences(F.col(text_col)), line_key).alias("keys"))
        .select("doc", "row", F.expr("transform(keys, x -> struct(xxhash64(x) as a, xxhash64(1, x) as b, char_length(x) as n))").alias("s"))
    )
    # Elements are taken one by one: a slice of an array costs its whole length.
    size = " + ".join(f"s[i + {j}].n" for j in range(k))
    # All keys but the first have a character, so that no run needs more sentences than this.
    widest = max(k, min_chars + 1)
    full = f"t.c >= {min_chars} and t.n >= {k}"
    grown = f"aggregate(sequence(i, least(i + {widest}, size(s)) - 1), struct(0 as c, 0 as n), (t, j) -> if({full}, t, struct(t.c + s[j].n as c, t.n + 1 as n)), t -> if({full}, t.n, null))"
    sized = keys.select("doc", "row", "s", F.expr(f"if(size(s) < {k}, array(), transform(sequence(0, size(s) - {k}), i -> if({size} >= {min_chars}, {k}, {grown})))").alias("sizes"))
    # Equal runs have equal sizes, and so one of the two forms.
    part = lambda f: f"if(n = {k}, xxhash64({', '.join(f's[i + {j}].{f}' for j in range(k))}), xxhash64(transform(sequence(i, i + n - 1), j -> s[j].{f})))"
    hashed = f"transform(sizes, (n, i) -> if(n is null, null, struct(n, {part('a')} as h1, {part('b')} as h2)))"
    runs = sized.select("doc", "row", F.posexplode(F.expr(hashed)).alias("pos", "h"))
    return runs.where("h is not null").select("doc", "row", "pos", "h.n", "h.h1", "h.h2")


def lost_runs(docs: DataFrame, k: int = K, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, pos, n) of each non-first repeated run, by its first sentence and its sentences.

    Rows that repeat a doc_id count as one document: runs that they share stay.  Rows
    with a null doc_id neither lose sentences nor make others lose them.
    """
    runs = stash(sentence_runs(docs, k, min_chars, id_col, text_col), "spans")
    owner = runs.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("times")).where("times > 1").select("h1", "h2", "first")
    owner = stash(owner, "owners")  # apart from the join, so that Spark can split a run that very many texts share
    again = stash(runs.join(owner, ["h1", "h2"]), "repeated-spans")
    for done in (runs, owner):
        unstash(done)
    between = again.where("doc <> first").select("doc", "row", "pos", "n")
    # In the first document, the first position stays; only such repeats are ranked.
    inside = again.where("doc = first").groupBy("h1", "h2", "doc", "row").agg(F.min("pos").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    within = again.where("doc = first").join(inside, ["h1", "h2", "doc", "row"]).where("pos <> least").select("doc", "row", "pos", "n")
    return between.unionByName(within)


def dedup_spans(docs: DataFrame, k: int = K, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus _n_sentences, _n_removed and _kept (the sentences that stay, one after another)."""
    # Each word of 64 sentences that a run touches gets the bits of those that it covers.
    words = (
        f"transform(sequence(pos div {WORD}, (pos + n - 1) div {WORD}), w -> struct(cast(w as int) as word,"
        f" shiftleft(-1L, cast(greatest(pos - w * {WORD}, 0) as int)) & shiftrightunsigned(-1L, cast({WORD - 1} - least(pos + n - 1 - w * {WORD}, {WORD - 1}) as int)) as bits))"
    )
    gone = (
        lost_runs(docs, k, min_chars, id_col, text_col)
        .select("doc", "row", F.explode(F.expr(words)).alias("w"))
        .groupBy("doc", "row", "w.word")
        .agg(F.bit_or("w.bits").alias("bits"))
        .groupBy("doc", "row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_gone"))
        .select(F.col("doc").alias("_doc"), F.col("row").alias("_row1"), "_gone")
    )
    rows = carried(docs, id_col, text_col).withColumn("_row0", row_key(F.col("_text")))
    joined = rows.join(gone, (F.col("_id") == F.col("_doc")) & (F.col("_row0") == F.col("_row1")), "left")
    covered = f"shiftright(coalesce(try_element_at(_gone, i div {WORD}), 0L), i % {WORD}) & 1L = 1L"
    pieces = joined.withColumn("_all", split_sentences(F.col("_text")))
    pieces = pieces.withColumn("_stay", F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(F.expr(f"filter(_all, (x, i) -> not ({covered}))")))
    return released(
        pieces,
        docs,
        _n_sentences=F.size("_all").cast("long"),
        _n_removed=(F.size("_all") - F.size("_stay")).cast("long"),
        _kept=F.when(F.col("_gone").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join("_stay", "")),
    )


def op3_span_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_spans(docs).select("doc_id", F.col("_kept").alias("text"), F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n][.!?\x20\x09-\x0D]*|[^.!?\n]+') AS p FROM documents),
listed AS (
  SELECT doc_id, p, list_transform(p, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM pieces),
sentences AS (
  SELECT doc_id, unnest(p) AS piece, unnest(keys) AS key, generate_subscripts(p, 1) AS pos FROM listed),
summed AS (
  SELECT doc_id, pos, length(key) AS size, sum(length(key)) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM sentences),
reached AS (
  SELECT doc_id, total, min(pos) AS pos FROM summed GROUP BY doc_id, total),
runs AS (
  SELECT s.doc_id, s.pos, greatest(s.pos + 1, r.pos) AS last
  FROM summed s ASOF JOIN reached r ON s.doc_id = r.doc_id AND s.total - s.size + 50 <= r.total),
ranked AS (
  SELECT r.doc_id, r.pos, r.last, row_number() OVER (PARTITION BY keys[r.pos:r.last] ORDER BY r.doc_id, r.pos) AS n
  FROM runs r JOIN listed l ON r.doc_id = l.doc_id WHERE r.last <= len(l.keys)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM ranked WHERE n > 1),
flag AS (
  SELECT s.doc_id, s.pos, s.piece, g.pos IS NOT NULL AS removed
  FROM sentences s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos),
done AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE removed) AS n_removed,
         string_agg(piece, '' ORDER BY pos) FILTER (WHERE NOT removed) AS kept
  FROM flag GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept, '') AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""
