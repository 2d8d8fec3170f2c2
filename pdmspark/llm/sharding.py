"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank says which part of its
source lies before it. Sorted by fractional rank all sources run side by side, so equal cuts of that order
are shards that each have the mixture of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_BITS, boxed, bucket_bits, cut, running_sum, seeded_hash, table, unboxed

SEED = "shard-1"
#: The table of sources is broadcast up to this many rows (some 100 bytes each).
BROADCAST_SOURCES = 50_000


def interleave(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (its place in the shard, from 0).

    Shards differ by one row at most. Null sources are one source. Rows with one id follow each other by a
    hash of all their columns, so only rows that repeat others wholly may change places. A hot source is ranked in hash buckets, and the order of all rows in
    buckets of fractional rank, which by construction are of equal size. With fewer rows than shards the
    last shards are empty. An empty table gives an empty result. ``df`` is read several times.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    df = boxed(df, F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), seeded_hash(seed, id_col).alias("_h"), whole.alias("_t"))
    n = df.count()
    bits = bucket_bits(n)
    one = F.lit(1).cast("long")
    ranked = df.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    ranked = running_sum(ranked, ["_src"], "_b", [F.col("_h"), F.col("_id"), F.col("_t")], one, "_rank")
    # The sources' sizes are broadcast if they are few; else both sides are tables, so that a hot source can be split.
    sizes = cut(df.groupBy(F.col("_src").alias("_source")).agg(F.count(one).alias("_n")))
    small = sizes.count() <= BROADCAST_SOURCES
    ranked = ranked.join(F.broadcast(sizes) if small else sizes, ranked["_src"].eqNullSafe(sizes["_source"])).drop("_source")
    # (2 rank + 1) / 2n lies inside (0, 1); a double holds it, and equal fractions of sources tie by hash.
    part = ranked.withColumn("_part", (2 * F.col("_rank") + 1) / (2 * F.col("_n")).cast("double"))
    part = part.withColumn("_b", F.floor(F.col("_part") * (1 << bits))).withColumn("_all", F.lit(0))
    placed = running_sum(cut(part), ["_all"], "_b", [F.col("_part"), F.col("_src"), F.col("_h"), F.col("_id"), F.col("_t")], one, "_at")
    shard = F.expr(f"cast((_at * {shards} + {shards - 1}) div {max(n, 1)} as int)")
    start = F.expr(f"({max(n, 1)}L * shard) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", (F.col("_at") - start).cast("long"))
    return unboxed(placed, ["shard", "slot"], F.col("shard"), F.col("slot"))


def op7_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard and slot of every row; see ``interleave``. Null texts have size 1 and the
    sum of an empty text; grown_shard is null, as the law is not ``key``."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    out = interleave(rows, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by half bytes, low one first: ``t`` has what a half byte adds. Ids are taken to be distinct.
SQL = r"""
WITH halves AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, ('0x' || substr(md5('shard-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents),
c AS (SELECT doc_id, source, place, strlen(text) + 1 AS size, CASE WHEN h = '' THEN []::BIGINT[] ELSE list_transform(string_split(h, ''), lambda x: (ascii(x) - CASE WHEN ascii(x) > 57 THEN 55 ELSE 48 END)::BIGINT) END AS a FROM d),
k AS (SELECT doc_id, source, place, size, list_transform(range(len(a)), lambda i: a[xor(i, 1) + 1]) AS a FROM c),
s AS (SELECT doc_id, source, place, size, xor(list_reduce(list_prepend(4294967295::BIGINT, a), lambda x, y: xor(x >> 4, t[(xor(x, y) & 15) + 1])), 4294967295) AS text_crc32 FROM k, halves),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY place, doc_id) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS part FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, place, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r),
g AS (SELECT *, (pos * 16 + 15) // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (pos - (n * shard) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM g
"""
