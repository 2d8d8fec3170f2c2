"""Mixing sources to target weights along a curriculum.

Every source has a weight for each phase of training, all phases being equally long. The integral of the
weights is the source's weight in the mixture, and its course the source's cumulative demand, a piecewise
linear function of training progress. A source's documents, in seeded order and repeated as often as
needed, supply its words one after the other; inverting the cumulative demand at the middle of a
document gives the document's position in training. Sorting by position by range mixes the sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HASH_BITS, WORD, boxed, bucket_bits, cut, running_sum, seeded_hash, table, unboxed

#: The table of sources is broadcast up to this many rows (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A source gives at most this many times its own words.
MAX_EPOCHS = 3.0
SEED = "mix-1"
#: Weights by phase of the sources in turn. Their means are 1, 2 and 3: the first come late, the last come early.
CURRICULUM = ((0.25, 0.75, 1.25, 1.75), (2.0, 2.0, 2.0, 2.0), (4.5, 3.5, 2.5, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Column, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``weights`` (an array, one weight a phase) made into demand.

    The sources share the sum of all sizes by mean weight; a null weight is none. A target stops at
    ``max_epochs`` times its source's size; the excess goes to the others by weight, until no target is above
    its limit. With sources by rising limit / weight, the first k are limited, and all others get weight times
    one level. Adds ``target`` (double) and ``cumulative``: the part of the target wanted by the end of each
    phase. One task has all rows, one a source.
    """
    added = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    shares = totals.withColumns({"_w": weights, "_all": F.lit(1)})
    shares = shares.withColumn("_sum", added(F.col("_w"))).withColumn("_weight", F.col("_sum") / F.size("_w"))
    # "size" times the limit is exact in a double, so the order and the sums do not depend on the plan.
    shares = shares.withColumn("_limit", F.col("source_size") * F.lit(float(max_epochs)))
    order = [F.try_divide("_limit", "_weight").asc_nulls_last(), F.col("source").asc_nulls_last()]
    before = Window.partitionBy("_all").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_all")
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = F.try_divide(F.sum("source_size").over(whole) - sum_before("_limit"), F.sum("_weight").over(whole) - sum_before("_weight"))
    levels = shares.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_weight") <= F.col("_limit"))
    final = F.min(F.when(F.col("_free"), F.struct(F.try_divide("_limit", "_weight").alias("r"), F.col("_level").alias("level")))).over(whole)["level"]
    out = levels.withColumn("_final", final)
    target = F.when(F.col("_weight") > 0, F.least(F.col("_limit"), F.col("_final") * F.col("_weight"))).otherwise(F.lit(0.0))
    running = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda k: F.try_divide(added(F.slice("_w", F.lit(1), k)), F.col("_sum")))
    return out.select("source", "source_size", target.alias("target"), running.alias("cumulative"))


def invert(cumulative: Column, part: Column) -> Column:
    """The training progress in [0, 1] at which ``part`` of the whole demand has been met."""
    n = F.size(cumulative)
    done = F.size(F.filter(cumulative, lambda c: c <= part))
    phase = F.least(done, n - 1)
    low = F.when(phase == 0, F.lit(0.0)).otherwise(F.try_element_at(cumulative, phase))
    high = F.try_element_at(cumulative, phase + 1)
    inside = F.coalesce(F.try_divide(part - low, high - low), F.lit(0.0))
    return F.least((phase + F.least(inside, F.lit(1.0))) / n, F.lit(1.0))


def schedule(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: str = SEED, measured: DataFrame | None = None) -> DataFrame:
    """Every row of ``df`` with source_size, target, repeats, taken and positions.

    ``positions`` has the training progress of each time the row is used, ``repeats`` of them, and
    ``taken`` is repeats times the row's size. A source's words are laid end to end, again and again,
    and a row is used each time its middle lies before the target: the words taken differ from the
    target by less than one row's. Null sources are one source. Rows of size 0 are used as others are.
    The order is by a seeded hash of the id, so reruns agree; rows with equal ids follow by size.
    A hot source is spread over hash buckets. ``measured`` is a stored table of the same rows' id, source
    and size, for the totals; without it ``df`` is read several times.
    """
    own = ["source_size", "target", "repeats", "taken", "positions"]
    measured = df if measured is None else measured
    bits = bucket_bits(measured.count())

    def bucketed(rows: DataFrame) -> DataFrame:
        h = rows.withColumn("_h", seeded_hash(seed, id_col))
        return h.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))

    order = [F.col("_h"), F.col(id_col), F.col(size_col)]
    laid = running_sum(bucketed(df.drop(*own)), [source_col], "_b", order, F.col(size_col), "_before", bucketed(measured))
    targets = targets.withColumnRenamed("source", "_source")
    small = targets.count() <= BROADCAST_SOURCES
    laid = laid.join(F.broadcast(targets) if small else targets, laid[source_col].eqNullSafe(targets["_source"]))
    middle = F.col("_before") + F.col(size_col) / F.lit(2.0)
    used = F.ceil(F.try_divide(F.col("target") - middle, F.col("source_size")))
    laid = laid.withColumn("repeats", F.greatest(F.coalesce(used, F.lit(0)), F.lit(0)).cast("long"))
    steps = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    positions = F.transform(steps, lambda k: invert(F.col("cumulative"), (middle + k * F.col("source_size")) / F.col("target")))
    out = laid.withColumn("taken", F.col("repeats") * F.col(size_col)).withColumn("positions", positions)
    return out.drop("_h", "_b", "_before", "_source", "cumulative")


def plan_targets(sized: DataFrame, weights: Column | None = None, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """The targets of all sources of ``sized``; by default the CURRICULUM's weights, repeating, by code point, null last."""
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    if weights is None:
        # One row a source: small beside the documents, and their order is a single one.
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        totals = totals.withColumn("_place", place)
        kinds = F.array(*[F.array(*[F.lit(x) for x in w]) for w in CURRICULUM])
        weights = F.element_at(kinds, (F.pmod("_place", F.lit(len(CURRICULUM))) + 1).cast("int"))
    return cut(source_targets(totals, weights))


def weights_from(table: Mapping[str | None, Sequence[float]]) -> Column:
    """Weights of ``plan_targets`` from a mapping of source to one weight a phase; a source not in it gets none."""
    phases = max(map(len, table.values()))
    out = F.array_repeat(F.lit(0.0), phases)
    for name, w in table.items():
        same = F.col("source").eqNullSafe(F.lit(name))
        out = F.when(same, F.array(*[F.lit(float(x)) for x in w])).otherwise(out)
    return out


def mix(df: DataFrame, weights: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mixture in training order, a row each time a document is used.

    Gives the columns of ``df`` and ``position``; partitions are ranges of positions, sorted within.
    An empty table, or one without words, gives no rows.
    """
    rows = boxed(df, F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    measured = cut(rows.select("id", "source", "size"))
    taken = schedule(rows, plan_targets(measured, weights), "id", measured=measured)
    placed = taken.select("_row", "id", F.explode("positions").alias("position"))
    placed = placed.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
    return unboxed(placed, ["position"], F.col("position"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken, and the training positions of its
    first and last use (null where it is not used), in the order of first use. Null texts have size 0; a null source is
    one source; rows that repeat an id follow each other by size; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    at = lambda k: F.try_element_at("positions", F.lit(k))
    out = schedule(sized, plan_targets(sized)).withColumns({"first_position": at(1), "last_position": at(-1)})
    out = out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [[0.25, 0.75, 1.25, 1.75]::DOUBLE[], [2, 2, 2, 2]::DOUBLE[], [4.5, 3.5, 2.5, 1.5]::DOUBLE[]][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS ws
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, list_sum(ws) / 4 AS weight, source_size * 3.0::DOUBLE AS cap,
         list_transform(range(1, 5), lambda k: list_sum(ws[:k]) / list_sum(ws)) AS cumulative
  FROM s
), l AS (
  SELECT *, cap / weight AS r,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, cumulative,
         least(cap, weight * arg_min(CASE WHEN level * weight <= cap THEN level END, CASE WHEN level * weight <= cap THEN r END) OVER ()) AS target
  FROM l
), laid AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d
), used AS (
  SELECT doc_id, size, source_size, target, cumulative, before + size / 2.0::DOUBLE AS middle,
         greatest(coalesce(ceil((target - (before + size / 2.0::DOUBLE)) / nullif(source_size, 0)), 0), 0)::BIGINT AS repeats
  FROM laid JOIN t ON laid.source IS NOT DISTINCT FROM t.source
), parts AS (
  SELECT *, middle / nullif(target, 0) AS a, (middle + (repeats - 1) * source_size) / nullif(target, 0) AS b FROM used
), phases AS (
  SELECT *, least(len(list_filter(cumulative, lambda c: c <= a)), 3) AS pa, least(len(list_filter(cumulative, lambda c: c <= b)), 3) AS pb FROM parts
), ends AS (
  SELECT *, CASE WHEN pa = 0 THEN 0 ELSE cumulative[pa] END AS la, CASE WHEN pb = 0 THEN 0 ELSE cumulative[pb] END AS lb FROM phases
)
SELECT doc_id, size, source_size, target, repeats * size AS taken,
       CASE WHEN repeats > 0 THEN least((pa + least(coalesce((a - la) / nullif(cumulative[pa + 1] - la, 0), 0), 1)) / 4, 1) END AS first_position,
       CASE WHEN repeats > 0 THEN least((pb + least(coalesce((b - lb) / nullif(cumulative[pb + 1] - lb, 0), 0), 1)) / 4, 1) END AS last_position
FROM ends
"""
