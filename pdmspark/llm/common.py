"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of blanks, and a word, as the contracts of these operators define them.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of ``seeded_hash``.
HASH_BITS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session in local mode may leave it unset; a folder of this machine serves then.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no rerun."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def boxed(df: DataFrame, *needed: Column) -> DataFrame:
    """``df`` as one struct column ``_row`` beside the columns an operator needs, so that no name clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *needed)


def unboxed(df: DataFrame, replaced: list[str] | tuple = (), *added: Column) -> DataFrame:
    """The columns of ``_row`` without those ``replaced``, and the columns ``added``."""
    gone = {x.lower() for x in replaced}
    names = [f.name for f in df.schema["_row"].dataType.fields if f.name.lower() not in gone]
    return df.select(*[F.col("_row")[n].alias(n) for n in names], *added)


def seeded_hash(seed: str, *cols: str) -> Column:
    """A uniform long below 2**60 from the columns' text; nulls count as the text ``null``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    text = F.concat_ws("|", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    """Leading hash bits to split a group by, so that a bucket of all rows has some hundreds of rows.

    The order of rows never depends on it; it only sizes the pieces of a distributed running sum.
    """
    return min(20, max(6, math.ceil(math.log2(max(rows, 1) / 512 + 1))))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str, totals_of: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before this row.

    Rows are ordered by ``bucket`` and then by ``order``, and ``bucket`` must not decrease along that
    order. Only bucket totals meet in one task per group; rows meet by (group, bucket). The totals come
    from ``totals_of``, a stored table with the same rows and fewer columns, if that is given.
    """
    keys = [*group, bucket]
    piece = (df if totals_of is None else totals_of).groupBy(*keys).agg(F.sum(value).alias("_piece"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_piece").over(before), F.lit(0)).alias("_offset"))
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(piece[f"_{k}"])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(piece, same).withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_offset", *[f"_{k}" for k in keys])
