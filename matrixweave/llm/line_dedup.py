"""Line dedup [native]: the first document that holds a line keeps it.

Lines are dealt by ranges of their hash and sorted by (hash, document, position) within
a range, once; a running window streams through each range and hands the first document
of a hash on to its other lines.  A hash so frequent that it would fill a range is dealt
again by document and position over as many ranges; each of them streams its own first
occurrence, and the smallest of these, a row a range, is handed on to all.  Frequent hashes are found in
a sample of the lines, which decides where lines are dealt, never what is kept.

What is returned per document is a sparse bitmap (64 lines a word, words with no
dropped line left out), not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrixweave.llm.common import carried, released, stash, unstash

#: The characters that are stripped from both ends of a line: fixed values.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
WORD = 64
#: Sampled lines a range, and how many of them a hash needs to be dealt by document and position.
SAMPLE, FREQUENT = 100, 10


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; other letters stay."""
    key = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def row_key(text: Column) -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def later_occurrences(lines: DataFrame) -> DataFrame:
    """The rows of ``lines(doc, row, pos, h1, h2)``, a written table, whose hash a smaller document holds too."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = lines.sample(min(1.0, SAMPLE * parts / max(1, lines.count())), seed=1)
    # At most SAMPLE / FREQUENT hashes a range.
    often = some.groupBy("h1", "h2").count().where(F.col("count") >= FREQUENT).select("h1", "h2", F.lit(True).alias("often"))
    often = stash(often, "frequent-lines")
    spread = f"cast(least(floor((h1 / 1.8446744073709552e19D + 0.5D) * {parts}), {parts - 1}) as int)"
    dealt = lines.join(F.broadcast(often), ["h1", "h2"], "left").withColumn("often", F.coalesce("often", F.lit(False)))
    dealt = dealt.withColumn("range", F.expr(f"if(often, {parts} + cast(pmod(xxhash64(doc, row, pos), {parts}) as int), {spread})"))
    run = dealt.repartitionByRange(parts, "range").sortWithinPartitions("range", "h1", "h2", "doc", "pos")
    stream = Window.partitionBy("range", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    later = stash(run.withColumn("first", F.first("doc").over(stream)).where("often or doc <> first"), "later-lines")
    least = later.where("often").groupBy("h1", "h2").agg(F.min("first").alias("least"))
    over = later.where("often").join(F.broadcast(least), ["h1", "h2"]).where("doc <> least")
    return later.where("not often").select("doc", "row", "pos").unionByName(over.select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, bitmap) for each document that loses lines.

    bitmap: array of (word, drop) in ascending word; bit b of drop is set if line
    64 * word + b goes.  Documents that keep all have no row.  Keys under
    ``min_chars`` code points never match.  Equal lines of one document all stay or
    all go.  Rows that repeat a doc_id count as one document; rows with a null
    doc_id neither lose lines nor make others lose them.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull() & (F.char_length(text_col) >= min_chars))
        .select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = stash(lines, "lines")  # texts are split and hashed once, not for each branch and sample below
    lost = later_occurrences(lines)
    unstash(lines)
    words = lost.groupBy("doc", "row", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")).alias("drop")
    )
    return words.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("word", "drop"))).alias("bitmap"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` plus _n_lines, _n_dropped and _kept (the text of the lines that stay, joined by newline)."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars).select(
        F.col("doc").alias("_doc"), F.col("row").alias("_row1"), F.map_from_entries("bitmap").alias("_drop"), F.expr("aggregate(bitmap, 0, (n, w) -> n + bit_count(w.drop))").alias("_n")
    )
    rows = carried(docs, id_col, text_col).withColumn("_row0", row_key(F.col("_text")))
    joined = rows.join(bitmaps, (F.col("_id") == F.col("_doc")) & (F.col("_row0") == F.col("_row1")), "left")
    kept = F.expr(
        f"array_join(filter(split(_text, '\\n'), (x, i) -> shiftright(coalesce(try_element_at(_drop, i div {WORD}), 0L), i % {WORD}) & 1L = 0L), '\\n')"
    )
    return released(
        joined,
        docs,
        _n_lines=F.size(split_lines(F.col("_text"))).cast("long"),
        _n_dropped=F.coalesce(F.col("_n"), F.lit(0)).cast("long"),
        _kept=F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept),
    )


def op4_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owner AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
flag AS (
  SELECT k.doc_id, k.pos, k.line, (o.first_doc IS NOT NULL AND o.first_doc <> k.doc_id) AS dropped
  FROM keyed k LEFT JOIN owner o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flag GROUP BY doc_id
"""
