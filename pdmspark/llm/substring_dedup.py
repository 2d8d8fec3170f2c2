"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts a text where it meets a pattern, so that cuts depend on what
stands there and not on where it stands: after an insertion the same chunks follow again. Chunks meet by
digest; a chunk that an earlier document (one with a smaller id) has too is repeated, and runs of repeated
chunks are spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, fresh_folder, table

#: Bytes that the hash sees; one place in ODDS fits its pattern, and is a cut unless another fits less than
#: LEAST bytes before, so that cuts depend on the bytes around them only. A chunk ends after MOST bytes in any
#: case: words repeated over and over may have no cuts. Chunks have some 50 bytes on average.
GEAR = 16
ODDS = 8
LEAST = 16
MOST = 96
#: Spans of fewer bytes are left alone.
MIN_SPAN = 80
#: Bytes that are hashed at a time, and chunks in a batch of rows.
PIECE, ROWS = 1 << 21, 1 << 16
#: A random number for each byte, by rule.
NUMBERS = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], "u4")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where the gear hash, h = 2 h + number of the byte, over GEAR bytes, fits the pattern."""
    if len(data) < GEAR:
        return np.zeros(0, "i8")
    h, width = NUMBERS[data], 1
    while width < GEAR:
        h = (h[:-width] << np.uint32(width)) + h[width:]
        width *= 2
    # The top half of the low GEAR bits depends on most of the window's bytes.
    middle = (h >> np.uint32(GEAR // 2 - 1)) & np.uint32(ODDS - 1)
    return np.flatnonzero(middle == 0) + GEAR


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the chunks of a text; the last is its length. An empty text has none."""
    buffer = np.frombuffer(data, "u1")
    found = [cut_points(buffer[max(0, at - GEAR + 1) : at + PIECE]) + max(0, at - GEAR + 1) for at in range(0, len(data), PIECE)]
    fits = np.concatenate([*found, np.zeros(0, "i8")])  # rising: pieces overlap by less than the hash sees
    fits = fits[np.diff(fits, prepend=-LEAST) >= LEAST]
    ends = fits if not data or len(fits) and fits[-1] == len(data) else np.append(fits, len(data))
    starts = np.concatenate([[0], ends[:-1]])
    if len(ends) and (ends - starts).max() > MOST:
        ends = np.array(sorted({*ends.tolist(), *(k for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for k in range(a + MOST, b, MOST))}))
    return ends.tolist()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): ``key``, a hash of the text, tells rows of one id or without any apart."""
    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """(id, key, start, length, d1, d2, again) of every chunk of ``docs`` (id, key, text), in UTF-8 bytes.

    d1 and d2 are a digest of 128 bits; ``again`` says that the text has the chunk before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of, names = xxhash.xxh3_128_digest, ["id", "key", "start", "length", "d1", "d2", "again"]
        held: list[tuple] = []
        n = 0

        def rows() -> pa.RecordBatch:
            ids, keys, ends, digests, again = zip(*held, strict=True)
            counts = np.array([len(x) for x in ends])
            stop = np.concatenate(ends)
            start = np.concatenate([[0], stop[:-1]])
            start[np.cumsum(counts) - counts] = 0
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of_docs = lambda x: pa.array(x, pa.int64()).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            out = [of_docs(ids), of_docs(keys), pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.concatenate(again))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ends = chunk_ends(data)
                if not ends:
                    continue
                digests = [digest_of(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                seen: set[bytes] = set()
                again = [d in seen or seen.add(d) is not None for d in digests] if len({*digests}) < len(digests) else np.zeros(len(ends), bool)
                held.append((doc_id, key, np.array(ends), b"".join(digests), again))
                n += len(ends)
                if n >= ROWS:
                    yield rows()
                    n = 0
        if held:
            yield rows()

    return docs.mapInArrow(run, "id long, key long, start long, length long, d1 long, d2 long, again boolean")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN, within: bool = False) -> DataFrame:
    """(id, key, start, length, n_chunks, first_id): the byte spans of repeated chunks, in UTF-8, of ``min_span`` bytes or more.

    ``first_id`` is the least id of the documents that have a chunk of the span; that document keeps it, so
    of every passage one place stays. With ``within``, chunks that the same text has before are repeated too,
    so that lines repeated in one document go; by default only other documents count. Rows with a null id come after
    all others: they lose what any row with an id has, and keep what only they have. Rows of one id are told apart
    by ``key``, the hash of their texts, and count as one document; rows that repeat both have the spans of one.
    Null and empty texts have no spans. An empty table gives an empty result. Chunks meet by 128-bit digests. Digests
    that many documents share are pre-aggregated, and their join is one that Spark splits. ``df`` is read once.
    """
    folder = fresh_folder(df.sparkSession, "chunks")
    chunks(_keyed(df, id_col, text_col).where("text is not null")).write.parquet(folder)
    all_chunks = df.sparkSession.read.parquet(folder)
    several = "first_id is not null and (first_id <> _last or _nulls > 0" + (" or _again)" if within else ")")
    owners = all_chunks.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.max("id").alias("_last"), F.count_if(F.col("id").isNull()).alias("_nulls"), F.bool_or("again").alias("_again"))
    owners = owners.where(several).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "first_id")
    owners = cut(owners)  # a table, so that Spark may split the partition of a hot digest in the join
    met = all_chunks.join(owners, (all_chunks["d1"] == owners["_d1"]) & (all_chunks["d2"] == owners["_d2"]))
    repeated = met.where("id > first_id or id is null" + (" or again" if within else "")).select("id", "key", "start", "length", "first_id")
    places = Window.partitionBy("id", "key").orderBy("start", "length")
    starts_run = F.coalesce(F.lag(F.col("start") + F.col("length")).over(places) < F.col("start"), F.lit(True))
    # A row that repeats another has the chunks of that one once more.
    counted = (~F.col("start").eqNullSafe(F.lag("start").over(places))).cast("long")
    runs = repeated.withColumns({"_run": F.sum(starts_run.cast("int")).over(places.rowsBetween(Window.unboundedPreceding, 0)), "_new": counted})
    spans = runs.groupBy("id", "key", "_run").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"), F.sum("_new").alias("n_chunks"), F.min("first_id").alias("first_id")
    )
    return spans.where(F.col("length") >= min_span).select("id", "key", "start", "length", "n_chunks", "first_id")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN, within: bool = False) -> DataFrame:
    """``df`` with the repeated spans cut out of the texts. A byte sequence broken by a cut is left out."""
    spans = cut(repeated_spans(df, id_col, text_col, min_span, within))
    lists = spans.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans")
    text = F.col(text_col)
    rows = boxed(df, F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    met = rows.join(lists, rows["id"].eqNullSafe(lists["_id"]) & (rows["key"] == lists["_key"]), "left")

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans_of in batches:
            out = []
            for text, found in zip(texts, spans_of, strict=True):
                if found is None or text is None:
                    out.append(text)
                    continue
                data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                for x in found:
                    kept.append(data[at : x["start"]])
                    at = x["start"] + x["length"]
                out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
            yield pd.Series(out, dtype="object")

    return met.select(*[without("text", "spans").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated span: doc_id, start, length, n_chunks and first_doc_id; see ``repeated_spans``."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), "start", "length", "n_chunks", F.col("first_id").alias("first_doc_id"))
