"""Panels, cell tables, sample maps and gene tables: read, checked and typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names that gene tables use for one thing, lower-cased: fixed values.
GENE_HEADERS = {
    "symbol": ("gene symbol", "gene_symbol", "symbol", "gene", "genesymbol"),
    "category": ("matrisome category", "category", "matrisome_category"),
    "division": ("matrisome division", "division", "matrisome_division"),
}
#: Spellings of flags: fixed values.
TRUE, FALSE = ("true", "1", "1.0", "t", "yes"), ("false", "0", "0.0", "f", "no")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with its header; names lose blanks at their ends."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*[c.strip() for c in df.columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def numbered(df: DataFrame, key: str = "cell_id", *by: str) -> DataFrame:
    """``df`` with dense ids from 0 in each group of ``by``, in the order of all its columns, so that they don't depend on partitions."""
    order = [F.col(c) for c in df.columns]
    return df.withColumn(key, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def panel(df: DataFrame, keep: str = "keep", name: str = "name", ecm: str = "ecm") -> DataFrame:
    """(pos, name, is_ecm) of the rows whose ``keep`` is 1 (all, without such a column), in their order ``pos``."""
    df = require(df.toDF(*[c.strip() for c in df.columns]), name, ecm)
    if "pos" not in df.columns:
        df = df.withColumn("pos", F.monotonically_increasing_id())
    own = df.where(F.col(keep) == 1) if keep in df.columns else df
    return own.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("pos"), F.trim(F.col(name).cast("string")).alias("name"), (F.col(ecm) == 1).alias("is_ecm"))


def panel_summary(rows: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(n_channels, n_ecm, aligned): aligned tells whether ``channels(pos, name)`` has the same names in the same order."""
    out = rows.agg(F.count("*").alias("n_channels"), F.sum(F.col("is_ecm").cast("int")).alias("n_ecm"))
    if channels is None:
        return out.withColumn("aligned", F.lit(None).cast("boolean"))
    differ = rows.select("pos", "name").exceptAll(channels.select(F.col("pos").cast("int"), "name")).count() + channels.select(F.col("pos").cast("int"), "name").exceptAll(rows.select("pos", "name")).count()
    return out.withColumn("aligned", F.lit(differ == 0))


def sample_groups(df: DataFrame, group: str, sample: str = "sample_id") -> DataFrame:
    """(sample_id, grp) without null pairs; a sample with two rows is an error."""
    own = require(df, group, sample).select(F.col(sample).alias("sample_id"), F.col(group).alias("grp")).dropna()
    twice = [r[0] for r in own.groupBy("sample_id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"samples have more than one row: {', '.join(map(str, twice))}")
    return own


def flag(column: Column) -> Column:
    """A boolean of the spellings that tables use; anything else is an error, null stays."""
    text = F.lower(F.trim(column.cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("boolean")
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).when(column.isNull(), None).otherwise(bad)


def overlays(df: DataFrame) -> DataFrame:
    """(sample_id, patch_id, is_artifact, replacement, reference) with strict types."""
    own = require(df, "sample_id", "patch_id", "is_artifact", "replacement", "reference")
    return own.select("sample_id", F.col("patch_id").cast("long").alias("patch_id"), flag(F.col("is_artifact")).alias("is_artifact"), F.col("replacement").cast("int").alias("replacement"), F.col("reference").cast("int").alias("reference"))


def genes(df: DataFrame) -> DataFrame:
    """(symbol, category, division): upper-case symbols, without null and "NAN" ones."""
    lower = {c.strip().lower(): c for c in df.columns}
    found = {k: next((lower[v] for v in names if v in lower), None) for k, names in GENE_HEADERS.items()}
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise ValueError(f"no column is the {', '.join(missing)}")
    own = df.select(F.upper(F.trim(F.col(f"`{found['symbol']}`").cast("string"))).alias("symbol"), *[F.col(f"`{found[k]}`").alias(k) for k in ("category", "division")])
    return own.where(F.col("symbol").isNotNull() & (F.col("symbol") != "NAN") & (F.col("symbol") != ""))


def input_summary(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per sample: cells, cell types, channels, height, width and range of values; samples that only one side has keep nulls."""
    a = cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.countDistinct("cell_type").alias("n_types"), F.sum(F.col("cell_type").isNull().cast("int")).alias("n_untyped"))
    b = pixels.groupBy("sample_id").agg(F.countDistinct("channel").alias("n_channels"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.min("v").alias("least"), F.max("v").alias("most"))
    return a.join(b, "sample_id", "full")


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of files that ``manifest(path, size, sha256)`` and ``files(path, length, content)`` don't agree on."""
    own = files.select("path", F.col("length").alias("_size"), F.sha2("content", 256).alias("_sha"))
    both = own.join(manifest, "path", "full")
    problem = F.when(F.col("size").isNull(), "not listed").when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_sha") != F.lower("sha256"), "digest")
    return both.select("path", problem.alias("problem")).where("problem is not null")
