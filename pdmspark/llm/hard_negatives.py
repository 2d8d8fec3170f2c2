"""Hard-negative mining, decomposed into slots of scores.

An anchor's nearest rows of its own label are its positives. Each positive asks for the best rows of other labels
whose score lies in a window below its own. These windows overlap; their upper limits cut the scores of an anchor into
disjoint slots. One pass keeps the best few rows of each slot, so a score is looked at once, however many windows hold
it; merging the slots from the lowest up then answers every window.

Rows travel as blocks of vectors. The anchors, a stated set of queries, meet all rows block by block: a cell is a block
of anchors and a group of some blocks of rows, so that no task holds more than that, whatever ids, labels or vectors
repeat. Cells return the best rows only, and those are merged by windows that Spark limits before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a block, blocks of rows in a cell, and anchors of a block.
BLOCK_ROWS, CELL_BLOCKS, ANCHOR_ROWS = 4096, 8, 512
#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOWER and at most UPPER hundredths of the positive's.
LOWER, UPPER = 50, 95
#: Scores computed at a time.
TILE = 1 << 22

BLOCK = "part int, place int, n int, width int, ids binary, no_id binary, labels binary, matrix binary"
BEST = "part int, place int, at int, anchor long, slot int, score long, id long"


def _packer(scale: float, rows: int):
    """(id, label, vector) rows as blocks; a row with a null label, a null vector or a component that is not finite goes."""

    def block(held: list[tuple], part: int, place: int) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0))
        matrix = np.zeros((len(held), max(len(r[2]) for r in held)))
        for k, r in enumerate(held):
            matrix[k, : len(r[2])] = r[2]
        matrix = np.floor(matrix * scale)
        width = 4 if not matrix.size or np.abs(matrix).max() < 1 << 24 else 8
        columns = [np.array(x, t).tobytes() for x, t in (([r[0] or 0 for r in held], "i8"), ([r[0] is None for r in held], "i1"), ([r[1] for r in held], "i8"))]
        row = [part, place, len(held), width, *columns, matrix.astype(f"f{width}").tobytes()]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            vectors = batch.column(2)
            values, ends = vectors.values.to_numpy(zero_copy_only=False).astype("f8"), vectors.offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in np.flatnonzero(good).tolist():
                held.append((ids[k], labels[k], values[ends[k] : ends[k + 1]]))
                if len(held) == rows:
                    yield block(held, part, place)
                    place, held = place + 1, []
        if held:
            yield block(held, part, place)

    return pack


class Vectors:
    """The rows of some blocks in order of id, those without an id last."""

    def __init__(self, blocks: pd.DataFrame):
        matrices = [np.frombuffer(m, f"f{w}").reshape(n, -1) for m, w, n in zip(blocks["matrix"], blocks["width"], blocks["n"], strict=True)]
        dim, kind = max(m.shape[1] for m in matrices), np.result_type(*matrices)
        matrix = np.concatenate([np.pad(m.astype(kind, copy=False), ((0, 0), (0, dim - m.shape[1]))) for m in matrices])
        ids, no_id, labels = (np.concatenate([np.frombuffer(x, t) for x in blocks[c]]) for c, t in (("ids", "i8"), ("no_id", "i1"), ("labels", "i8")))
        order = np.lexsort((ids, no_id))
        self.matrix, self.ids, self.no_id, self.labels = matrix[order], ids[order], no_id[order], labels[order]
        self.largest = float(np.abs(matrix).max()) if matrix.size else 0.0


def tiles(anchors: np.ndarray, largest: float, rows: np.ndarray, rows_largest: float) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first anchor, scores of some anchors with all rows); exact up to 53 bits."""
    dim = max(anchors.shape[1], rows.shape[1])
    kind = "f4" if largest * rows_largest * dim < 1 << 24 else "f8"  # integers that add up exactly, in any order
    a, b = (np.pad(m.astype(kind, copy=False), ((0, 0), (0, dim - m.shape[1]))) for m in (anchors, rows))
    step = max(1, TILE // max(1, len(b)))
    for k in range(0, len(a), step):
        yield k, a[k : k + step] @ b.T


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, larger first, earlier places first among equals."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.argsort(-scores[among], kind="stable")[:k]]


def _found(out: list[tuple], own: Vectors | None, rows: Vectors | None) -> pd.DataFrame:
    """(part, place, at, slot, score, row) as rows of BEST."""
    part, place, at, slot, score, row = [np.array(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, "i8")] * 6
    named = lambda v, k: pd.Series(v.ids[k], dtype="Int64").mask(v.no_id[k] == 1) if len(k) else pd.Series([], dtype="Int64")
    score = np.clip(score.astype("f8"), 1024 - 2.0**63, 2.0**63 - 1024).astype("i8")
    return pd.DataFrame({"part": part, "place": place, "at": at, "anchor": named(own, at), "slot": slot, "score": score, "id": named(rows, row)})


def _cell(search):
    """A function for cogroups: what ``search`` finds of each block of anchors in the rows of a cell."""

    def cell(rows_of: pd.DataFrame, anchors_of: pd.DataFrame) -> pd.DataFrame:
        found = [_found([], None, None)]
        if len(rows_of) and len(anchors_of):
            rows = Vectors(rows_of)
            for k in range(len(anchors_of)):
                block = anchors_of.iloc[[k]]
                own, part, place = Vectors(block), int(block["part"].iloc[0]), int(block["place"].iloc[0])
                found.append(_found([(part, place, *x) for x in search(own, rows, block)], own, rows))
        return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    return cell


def _nearest(k: int):
    """Of each anchor the k + 1 best rows of its label: (anchor, 1 if it may be the anchor itself, score, row)."""

    def search(own: Vectors, rows: Vectors, _) -> Iterator[tuple]:
        for label in np.unique(own.labels).tolist():
            mine, theirs = np.flatnonzero(own.labels == label), np.flatnonzero(rows.labels == label)
            if not len(theirs):
                continue
            for first, scores in tiles(own.matrix[mine], own.largest, rows.matrix[theirs], rows.largest):
                for j, line in enumerate(scores):
                    at = int(mine[first + j])
                    for x in best_of(line, k + 1).tolist():
                        row = int(theirs[x])
                        same = own.no_id[at] == rows.no_id[row] and own.ids[at] == rows.ids[row] and equal(own.matrix[at], rows.matrix[row])
                        yield at, int(same), line[x], row

    return search


def equal(a: np.ndarray, b: np.ndarray) -> bool:
    """Vectors that differ at most by zeros at the end."""
    n = min(len(a), len(b))
    return bool((a[:n] == b[:n]).all() and not a[n:].any() and not b[n:].any())


def _in_slots(k: int):
    """Of each anchor the k best rows of other labels in each slot that its windows reach: (anchor, slot, score, row)."""

    def search(own: Vectors, rows: Vectors, block: pd.DataFrame) -> Iterator[tuple]:
        asked = {w["at"]: (w["low"], np.array(w["uppers"], "f8")) for w in block["windows"].iloc[0]}
        mine = np.array(sorted(asked), "i8")
        for first, scores in tiles(own.matrix[mine], own.largest, rows.matrix, rows.largest):
            for j, line in enumerate(scores):
                at = int(mine[first + j])
                low, uppers = asked[at]
                among = np.flatnonzero((line >= low) & (line <= uppers[-1]) & (rows.labels != own.labels[at]))
                slots = np.searchsorted(uppers, line[among])  # a slot reaches from above the last upper limit to its own
                for slot in np.unique(slots).tolist():
                    inside = among[slots == slot]
                    for x in best_of(line[inside], k).tolist():
                        yield at, slot, line[inside[x]], int(inside[x])

    return search


def _met(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, search) -> DataFrame:
    """``search`` on every group of rows with every block of anchors."""
    key = F.pmod(F.xxhash64("part", "place"), F.lit(groups)).cast("int").alias("group")
    spread = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
    asked = anchors.select(F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "*")
    return spread.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(_cell(search), BEST)


def _limited(df: DataFrame, k: int, *more: str) -> DataFrame:
    """The best k rows of each anchor and slot."""
    order = Window.partitionBy("part", "place", "at", *more).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def _listed(df: DataFrame) -> DataFrame:
    """``best`` of each anchor: its rows, the larger scores of a slot first, slots from the lowest up."""
    row = F.struct("slot", (-F.col("score")).alias("down"), F.col("id").isNull().alias("no_id"), "id", "score")
    return df.groupBy("part", "place", "at").agg(F.first("anchor").alias("anchor"), F.sort_array(F.collect_list(row)).alias("best"))


def _suffixes(best: Column, uppers: Column, k: int) -> Column:
    """The k best rows of each slot and all below it, by slot: lists merged from the lowest slot up."""
    none = F.filter(best, lambda _: F.lit(False))
    start = F.struct(none.alias("top"), F.array(none).alias("tops"))

    def merge(held: Column, slot: Column) -> Column:
        top = F.slice(F.concat(F.filter(best, lambda r: r["slot"] == slot), held["top"]), 1, k)
        return F.struct(top.alias("top"), F.concat(held["tops"], F.array(top)).alias("tops"))

    return F.slice(F.aggregate(F.sequence(F.lit(0), F.size(uppers) - 1), start, merge)["tops"], 2, 1 << 30)


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: float = SCALE,
) -> DataFrame:
    """Hard negatives of every row of ``df`` where ``anchor`` holds: anchor_id, positive_id, rank, negative_id, both scores.

    Components become floor(scale * x), and a score is the inner product of these, exact up to 53 bits; a shorter vector
    is filled up with zeros. An anchor's positives are the best other rows of its label; of each the best rows of
    other labels are returned whose score is at least ``lower`` and at most ``upper`` hundredths of the positive's. Equal
    scores go by id, a null id last. Labels are integers. Rows with a null label, a null vector or a component that is
    null or not finite take no part. Rows that repeat an id or a whole row count as rows of their own, so they may be
    each other's positives. An empty table, no anchor, or no row in any window give an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asked"))
    queries = rows.where("asked").drop("asked")
    blocks = max(1, -(-queries.count() // ANCHOR_ROWS))
    queries = cut(queries.repartition(blocks).mapInArrow(_packer(scale, 2 * ANCHOR_ROWS), BLOCK))
    rows = cut(rows.drop("asked").mapInArrow(_packer(scale, BLOCK_ROWS), BLOCK))
    groups = max(1, -(-rows.count() // CELL_BLOCKS))

    # Positives: the anchor itself, or a row wholly like it, is left out once.
    near = _listed(_limited(_met(rows, queries, groups, blocks, _nearest(positives)).withColumn("self", F.col("slot")).withColumn("slot", F.lit(0)), positives + 1).withColumn("slot", F.col("self")))
    order = F.array_sort(F.transform("best", lambda r: F.struct(r["down"].alias("down"), r["no_id"].alias("no_id"), r["id"].alias("id"), r["slot"].alias("self"), r["score"].alias("score"))))
    itself = F.array_position(F.transform("order", lambda r: r["self"]), 1)
    kept = F.slice(F.filter("order", lambda r, i: i != F.col("itself") - 1), 1, positives)
    limit = lambda score, what, of: F.expr(f"cast({what}(cast({score} as decimal(20, 0)) * {of} / 100) as long)")
    near = near.withColumn("order", order).withColumn("itself", itself).withColumn("kept", kept)
    asked = near.select("part", "place", "at", "anchor", F.posexplode("kept").alias("no", "row")).select(
        "part", "place", "at", F.col("anchor").alias("anchor_id"), "no", F.col("row.id").alias("positive_id"), F.col("row.score").alias("positive_score"),
        limit("row.score", "ceil", lower).alias("low"), limit("row.score", "floor", upper).alias("high"),
    )
    asked = cut(asked.where("low <= high"))

    # Slots of each anchor, and its best rows in each.
    slots = asked.groupBy("part", "place", "at").agg(F.min("low").alias("low"), F.array_sort(F.collect_set("high")).alias("uppers"))
    windows = slots.groupBy("part", "place").agg(F.collect_list(F.struct("at", "low", "uppers")).alias("windows"))
    found = _limited(_met(rows, queries.join(windows, ["part", "place"]), groups, blocks, _in_slots(negatives)), negatives, "slot")

    tops = _listed(found).drop("anchor").join(slots.drop("low"), ["part", "place", "at"]).withColumn("tops", _suffixes(F.col("best"), F.col("uppers"), negatives))
    out = asked.join(tops, ["part", "place", "at"])
    answer = F.filter(F.element_at("tops", F.array_position("uppers", F.col("high")).cast("int")), lambda r: r["score"] >= F.col("low"))
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("before", "row"))
    return out.select("anchor_id", "positive_id", (F.col("before") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"), "positive_score", F.col("row.score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50, against all rows; see ``mine``. Where vec_id is
    divisible by 7, the label is first replaced by (label + 1) % 10. A row with a null vec_id is no anchor."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, e.rid AS other, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e a, e WHERE a.vec_id % 50 = 0 AND a.rid <> e.rid
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
