"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints at most ``RADIUS`` = 3 bits apart meet halfway: leave out one of ``PARTS`` parts of the
bits, one that holds a differing bit, and at most 2 bits differ in the rest, so that a value within 1 bit of
both exists there. Each distinct fingerprint thus emits, for each part left out, the rest and all variants of
it with one bit flipped (131 in all); fingerprints meet by variant, and those that do are verified.

A variant that many distinct fingerprints share would make many pairs, so these link in two steps without them.

1. The fingerprints that one flipped bit turns into the same whole value are at most 2 bits apart: all of them link
   to the least. That is every link of 2 bits or less, and makes one component of most crowds.
2. What is left are links of exactly 3 bits between components that share a variant. Such a link has a whole value 1
   bit from the one and 2 from the other. All fingerprints of variants with several components emit the values within
   1 bit; those outside the variant's largest component also values within 2, but only where the link can be: the
   variant's bit and one of the part left out or, of a variant without a flipped bit, two of the part left out. All
   those at a value link to the least of those within 1 bit of it.

   This finds every link: if it has no bit in common with the variant's part left out but 1 or 2, one of the two
   fingerprints has the value with a flipped bit and lies outside, in this variant or in that of the other one
   (components are ordered alike in all variants); if all 3 bits are in the part left out, both have the variant
   without a flipped bit, and one of them lies outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, table, unboxed
from .components import connected_components

BITS = 64
RADIUS = 3
PARTS = 3
SHINGLE = 3
SEED = 42
#: Variants of more than three fingerprints are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_VARIANTS = 200_000
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, "i8")
    for at in range(0, len(ends), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=False)], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(ends)).tolist())


def simhash(text: Column, width: int = SHINGLE) -> Column:
    """Fingerprints as signed longs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, width) for x in texts], "u8").view("i8"))

    return F.pandas_udf(run, "long")(text)


def _long(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def part_masks(parts: int = PARTS) -> list[tuple[int, list[int]]]:
    """(mask of the bits that stay, the bits left out) of each part."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    return [((1 << BITS) - 1 - sum(1 << k for k in range(a, b)), list(range(a, b))) for a, b in zip(edges, edges[1:], strict=False)]


def half_variants(parts: int = PARTS) -> Column:
    """An array of (mask, flip): ``fp & mask ^ flip`` are the variants within half the radius."""
    out = [(mask, flip) for mask, _ in part_masks(parts) for flip in (0, *(1 << k for k in range(BITS) if mask >> k & 1))]
    return F.array(*[F.struct(F.lit(_long(m)).alias("mask"), F.lit(_long(f)).alias("flip")) for m, f in out])


def _emit(fps: DataFrame) -> DataFrame:
    """(variant, fp, mask, whole): ``whole`` is the fingerprint with the variant's bit flipped."""
    rows = fps.select("fp", F.explode(half_variants()).alias("x"))
    fp, mask, flip = F.col("fp"), F.col("x.mask"), F.col("x.flip")
    return rows.select(fp.bitwiseAND(mask).bitwiseXOR(flip).alias("variant"), "fp", mask.alias("mask"), fp.bitwiseXOR(flip).alias("whole"))


def _within_one(fps: DataFrame) -> DataFrame:
    """(value, fp): the whole values one bit from each fingerprint."""
    flips = F.lit([_long(1 << k) for k in range(BITS)])
    return fps.select(F.explode(flips).alias("x"), "fp").select(F.col("fp").bitwiseXOR(F.col("x")).alias("value"), "fp")


def _towards(rows: DataFrame) -> DataFrame:
    """(value, fp): the whole values two bits from a fingerprint that a link of 3 bits within its variant can have."""
    flips = None
    for mask, bits in part_masks():
        one = F.lit([_long(1 << k) for k in bits])
        two = F.lit([_long(1 << j | 1 << k) for j, k in combinations(bits, 2)])
        own = F.when(F.col("whole") == F.col("fp"), two).otherwise(one)
        same = F.col("mask") == _long(mask)
        flips = F.when(same, own) if flips is None else flips.when(same, own)
    return rows.select("whole", "fp", F.explode(flips).alias("x")).select(F.col("whole").bitwiseXOR(F.col("x")).alias("value"), "fp").distinct()


def _with_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the component of their fp by ``edges``; a fingerprint without any is one of its own."""
    groups = connected_components(edges)
    return rows.join(groups, rows["fp"] == groups["node"], "left").drop("node").withColumn("component", F.coalesce("component", "fp"))


def _links_between(found: DataFrame) -> DataFrame:
    """Pairs (u, v) that join the components of ``found`` (variant, fp, mask, whole, component) wherever 3 bits do."""
    sizes = found.select("fp", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed("component", "_c")
    ranked = found.join(sizes, found["component"] == sizes["_c"]).withColumn("_rank", F.struct("_size", "component"))
    most = ranked.groupBy("variant").agg(F.max("_rank").alias("_most"), F.min("_rank").alias("_least")).where("_most <> _least").select(F.col("variant").alias("_variant"), "_most")
    mixed = cut(ranked.join(most, ranked["variant"] == most["_variant"]).select("fp", "mask", "whole", (F.col("_rank") < F.col("_most")).alias("outside")))
    hubs = _within_one(mixed.select("fp").distinct()).groupBy("value").agg(F.min("fp").alias("u")).withColumnRenamed("value", "_value")
    wide = _towards(mixed.where("outside").select("fp", "mask", "whole"))
    return wide.join(hubs, wide["value"] == hubs["_value"]).select("u", F.col("fp").alias("v"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at most RADIUS bits apart whose components are those of all such pairs.

    ``fps`` has each fingerprint once, as ``fp``, and is read twice. Of variants of up to three fingerprints all links
    are given; of others those that connect them. A fingerprint emits 131 variants; where those around it stay in
    several components it emits 64 whole values more, and at most the 2,016 two bits away.
    """
    emitted = _emit(fps)
    met = emitted.select("variant", "fp").repartition("variant").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"), F.bit_xor("fp").alias("x"))
    met = cut(met.where("n > 1"))
    # Two or three fingerprints of a variant are known from their least, their greatest and the xor of all.
    middle = F.col("x").bitwiseXOR(F.col("u")).bitwiseXOR(F.col("v"))
    pairs = met.where("n <= 3").select("u", "v")
    three = met.where("n = 3")
    pairs = pairs.unionByName(three.select("u", middle.alias("v"))).unionByName(three.select(middle.alias("u"), "v"))
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).distinct()

    more = met.where("n > 3").select(F.col("variant").alias("_variant"))
    small = more.count() <= BROADCAST_VARIANTS
    found = cut(emitted.join(F.broadcast(more) if small else more, emitted["variant"] == more["_variant"]).select("variant", "fp", "mask", "whole"))
    # At most 65 fingerprints have one whole value within a bit.
    stars = found.select("whole", "fp").distinct().withColumn("u", F.min("fp").over(Window.partitionBy("whole"))).select("u", F.col("fp").alias("v")).where("u <> v").distinct()
    pairs = cut(pairs.unionByName(stars))
    known = cut(_with_components(found, pairs))
    return pairs.unionByName(_links_between(known)).where("u <> v").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, component, component_id) of every row, by component.

    component_id is the least id that links reach, itself included; component is a fingerprint of the
    component. Null, empty and blank texts have fingerprint 0, which links like any other. Equal texts have
    equal fingerprints, so groups of copies are one node. Rows with a null id have a component, but are no
    one's component_id unless all of it have null ids; then it is null. An empty table gives an empty result.
    """
    text = F.col(text_col)
    docs = cut(df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), simhash(text).alias("fp")))
    nodes = cut(docs.groupBy("fp").agg(F.min("id").alias("least")))
    groups = cut(connected_components(links(nodes.select("fp"))))
    known = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    return docs.join(named, docs["fp"] == named["_fp"]).select("id", "text_hash", "fp", "component", "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each component: that with the least id, null ids last, then the
    least hash of its text; one of rows that repeat both id and text. Has the columns of ``df``."""
    found = near_duplicates(df, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash"))
    stay = found.groupBy("component").agg(first.alias("best")).select("best.id", "best.text_hash")
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_hash"))
    stay = stay.select(key.alias("_stay"))
    rows = boxed(df, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).select("_row", key.alias("_key"))
    once = F.row_number().over(Window.partitionBy("_key").orderBy("_key")) == 1
    return unboxed(rows.join(stay, rows["_key"] == stay["_stay"], "left_semi").withColumn("_once", once).where("_once"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row; see ``near_duplicates`` for nulls, empty texts and repeated rows."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
