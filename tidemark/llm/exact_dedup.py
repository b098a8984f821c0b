"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by (first characters, hash, salt) of the normalised text, an external sort
places equal texts next to each other, and the window operator's comparison of neighbouring keys, over the whole
normalised text, finds the groups. The splitters hold a short prefix and a hash, never a whole text, so the sample that
the driver sees stays small however long the texts are.

A text with more copies than 1/10,000 of all rows is salted into sub-blocks of about that size; there are at most 10,000
such texts, so the table of hot hashes (16 bytes a row) and the table of their sub-blocks' merged heads are bounded.

Defined results: a null text counts as empty, and empty texts are equal to each other. A null id sorts last. Of rows
that tie in length and id, one stays. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stage, table, without_space

#: At most so many texts are salted, each with at least total/HOT_GROUPS rows.
HOT_GROUPS = 10_000
LEAST_HOT = 64
SPLITTER_CHARS = 24


def _sorted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns as _row, with _id, _n, _norm, _salt, _is_hot and, within sub-blocks of equal texts, _rank, _keep, _size."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = without_space(text)
    counts = stage(docs.groupBy(F.xxhash64(norm).alias("_h")).count(), "dedup-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = max(LEAST_HOT, total // HOT_GROUPS)
    hot = counts.filter(F.col("count") > most).select(F.col("_h").alias("_hot"), F.ceil(F.col("count") / most).cast("long").alias("_salts"))

    own = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), norm.alias("_norm"))
    rows = own.withColumn("_h", F.xxhash64("_norm")).join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("long")
    keyed = rows.select("_row", "_id", "_h", F.substring("_norm", 1, SPLITTER_CHARS).alias("_p"), salt.alias("_salt"), F.col("_hot").isNotNull().alias("_is_hot"))

    placed = keyed.repartitionByRange("_p", "_h", "_salt")
    text = F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit(""))
    placed = placed.withColumn("_norm", without_space(text)).withColumn("_n", F.length(text).cast("long"))
    group = Window.partitionBy("_p", "_h", "_salt", "_norm").orderBy(F.col("_n").desc(), F.col("_id").asc_nulls_last())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumns({"_rank": F.row_number().over(group), "_keep": F.first("_id").over(whole), "_size": F.count(F.lit(1)).over(whole)})


def _merged(heads: DataFrame) -> DataFrame:
    """One row for each salted text: hash, the best head of its sub-blocks, and its number of copies."""
    best = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_salt").alias("salt"))
    return heads.groupBy(F.col("text_sha256").alias("_sha")).agg(F.min(best).alias("_best"), F.sum("_size").alias("_all"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    found = _sorted(docs.select(id_col, text_col), id_col, text_col)
    found = stage(found.select("_id", "_n", "_salt", "_is_hot", "_rank", "_keep", "_size", F.sha2("_norm", 256).alias("text_sha256")), "dedup-found")
    merged = _merged(found.filter(F.col("_is_hot") & (F.col("_rank") == 1)))
    out = found.join(F.broadcast(merged), F.col("text_sha256") == F.col("_sha"), "left")
    first = (F.col("_rank") == 1) & (F.col("_sha").isNull() | (F.col("_salt") == F.col("_best.salt")))
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_sha").isNull(), F.col("_keep")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_all", "_size").cast("long").alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    heads = _sorted(docs, id_col, text_col).filter(F.col("_rank") == 1)
    heads = stage(heads.select("_row", "_id", "_n", "_salt", "_is_hot", "_size", F.when(F.col("_is_hot"), F.sha2("_norm", 256)).alias("text_sha256")), "dedup-heads")
    merged = _merged(heads.filter("_is_hot"))
    out = heads.join(F.broadcast(merged), F.col("text_sha256") == F.col("_sha"), "left")
    return out.filter(F.col("_sha").isNull() | (F.col("_salt") == F.col("_best.salt"))).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
      FROM documents)
WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
