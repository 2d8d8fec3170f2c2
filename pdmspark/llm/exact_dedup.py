"""Exact deduplication with a heavy-hitter split.

Spark's ``approx_top_k`` keeps Misra-Gries counters (a frequent-items sketch) and so finds the digests
that many rows share without shuffling them. Their exact winners are a table of at most ``MAX_HEAVY``
rows, which is broadcast: rows of hot groups are decided where they are read. All other digests meet by
an ordinary shuffle, in groups that the sketch proves to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, boxed, cut, table, unboxed

#: Most digests treated as heavy, hence the bound of the broadcast: 1,000 rows of under 200 bytes.
MAX_HEAVY = 1000
#: Counters of the sketch. A digest of more than 1/4000 of the rows is always among them.
COUNTERS = 10000


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of blanks replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256)


def heavy_winners(df: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """(digest, winner id, exact group size) of the frequent digests; at most MAX_HEAVY rows."""
    sketch = df.select(F.expr(f"approx_top_k(`{digest_col}`, {MAX_HEAVY}, {COUNTERS})").alias("top"))
    found = sketch.select(F.explode("top").alias("hit")).select(F.col("hit.item").alias("_digest"))
    found = found.where(F.col("_digest").isNotNull())
    return (
        df.join(F.broadcast(found), df[digest_col] == found["_digest"])
        .groupBy("_digest")
        .agg(F.min(id_col).alias("_winner"), F.count(F.lit(1)).alias("_size"))
    )


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", digest_col: str = "text_sha256") -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size`` and ``kept``.

    Rows are equal when their digests are. Of equal rows the one with the smallest id is kept; a null id
    comes last. Where several rows have that id, exactly one of them is kept. An empty table gives an
    empty result. ``df`` is read twice, so pass a stored table. Columns of df that have the names of
    result columns are replaced.
    """
    df = df.drop("keep_id", "group_size", "kept")
    columns = df.columns
    winners = cut(heavy_winners(df, id_col, digest_col))
    near = F.broadcast(winners)

    hot = df.join(near, df[digest_col] == winners["_digest"])
    best = F.col(id_col).eqNullSafe(F.col("_winner"))
    decided = [F.col("_winner").alias("keep_id"), F.col("_size").alias("group_size")]
    lost = hot.where(~best).select(*columns, *decided, F.lit(False).alias("kept"))
    # Rows that repeat the winner's id: one of them stays.
    first = F.row_number().over(Window.partitionBy(digest_col).orderBy(id_col)) == 1
    won = hot.where(best).select(*columns, *decided, first.alias("kept"))

    group = Window.partitionBy(digest_col)
    first = F.row_number().over(group.orderBy(F.col(id_col).asc_nulls_last())) == 1
    rest = df.join(near, df[digest_col] == winners["_digest"], "left_anti").select(
        *columns, F.min(id_col).over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), first.alias("kept")
    )
    return lost.unionByName(won).unionByName(rest)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df`` only."""
    rows = boxed(df, F.col(id_col).alias("id"), normal_digest(F.col(text_col)).alias("sha256"))
    return unboxed(mark_duplicates(rows, "id", "sha256").where("kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = cut(docs.select("doc_id", normal_digest(F.col("text")).alias("text_sha256")))
    return mark_duplicates(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
