"""Suffix-array deduplication with prefix-free parsing.

Which stretches of LENGTH bytes of the corpus start at more than one place? In corpus order, the order of all
suffixes, equal stretches stand side by side.

Shards. A stretch goes to the shard of the least hash of its GRAM-byte strings: equal stretches have equal
least hashes, so they meet, and stretches that follow each other in a text mostly share it, so they travel
as one segment. Hashes of one segment alone, nearly all in unrepetitive text, are dropped after counting
them, and equal segments travel once. Only what may repeat is sorted.

Prefix-free parsing. In a shard, triggers of a rolling hash end phrases, which overlap by the trigger, so that
no suffix of a phrase longer than it is a prefix of another. The distinct phrases are the dictionary, and a
segment is a sequence of their ranks, the parse. Suffix arrays of the dictionary (by 8-byte words) and of the
parse (by prefix doubling) give every place two ranks: of the rest of its phrase, and of the parse behind it;
sorted by both, places are in corpus order. Neighbours are compared byte by byte.

A shard of too many different segments, as at the edges of a passage that very many documents share, is not
sorted in one task: its stretches meet by 128-bit digests, which Spark pre-aggregates and spreads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_folder, table

LENGTH = 400
#: Bytes of the strings whose least hash is a stretch's shard.
GRAM = 128
#: Stretches in a segment at most, places of a text hashed at a time.
RUN, PLACES = 4096, 1 << 20
#: Bytes of different segments of a shard that one task sorts; and of the shards sorted together.
MOST_BYTES, BATCH_BYTES = 4 << 20, 2 << 20
#: Bytes of different segments for each task, whatever the input has; and the most tasks.
TASK_BYTES, MOST_TASKS = 1 << 20, 200_000
#: Bytes of a trigger; one place in ODDS is one.
TRIGGER, ODDS = 8, 32
#: Random numbers for bytes, by rule, and odd multipliers of the rolling hashes.
NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 8) for b in range(256)], "u8")
BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of ``width`` bytes (a sum of powers of two of them), at its first place."""
    parts, at, h, size, power = None, 0, NUMBERS[data], 1, BASE
    n = len(data) - width + 1
    while True:
        if width & size:
            here = h[at : at + n]
            factor = np.uint64(pow(BASE, size, 1 << 64))
            parts = here.copy() if parts is None else parts * factor + here
            at += size
        if size * 2 > width:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    return (parts ^ (parts >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks both ways."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bool]]:
    """(shard, start, end, again): segments that have every stretch of the text once. ``end`` is behind its last byte.

    ``again`` says that the string of the shard's hash is in the segment twice, so that a stretch may be, too.
    """
    buffer = np.frombuffer(data, "u1")
    for base in range(0, len(data) - length + 1, PLACES):
        h = rolling(buffer[base : base + PLACES + length - 1], gram)
        least = sliding_min(h, length - gram + 1)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
        keys = least[cuts[:-1]].view("i8").tolist()
        for key, a, b in zip(keys, cuts, cuts[1:], strict=False):
            value = least[a]
            for at in range(a, b, RUN):
                to = min(at + RUN, b)
                yield key, base + at, base + to + length - 1, int(np.count_nonzero(h[at : to + length - gram] == value)) > 1


def word_ranks(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of the dictionary the rank of the rest of its phrase; equal rests have equal ranks."""
    n = len(text)
    rest = np.repeat(ends, ends - begins) - np.arange(n)
    words = np.concatenate([text, np.zeros(8, "u1")]).astype("u8")
    for k in (1, 2, 4):
        words = (words[:-k] << np.uint64(8 * k)) | words[k:]
    words = np.concatenate([words, np.zeros(16, "u8")])
    rank, active, depth = np.zeros(n, "i8"), np.arange(n), 0
    while len(active):
        left = np.clip(rest[active] - depth, 0, 8)
        shift = ((8 - left) * 8).astype("u8")
        word = np.where(left > 0, (words[np.minimum(active + depth, n)] >> np.minimum(shift, 63)) << np.minimum(shift, 63), 0)
        old = rank[active]
        order = np.lexsort((left, word, old))
        o, w, l = old[order], word[order], left[order]  # noqa: E741
        new = np.concatenate([[True], (np.diff(o) != 0) | (np.diff(w) != 0) | (np.diff(l) != 0)])
        group = np.concatenate([[True], np.diff(o) != 0])
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active[order]] = o + start - first
        sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
        many = np.repeat(sizes > 1, sizes) & (l == 8)
        active, depth = active[order][many], depth + 8
    return rank


def parse_ranks(parse: np.ndarray, most: int) -> np.ndarray:
    """Ranks of the suffixes of the parse by their first ``most`` phrases or more, by prefix doubling."""
    rank, done = np.unique(parse, return_inverse=True)[1].astype("i8"), 1
    while done < most and rank.max(initial=0) < len(parse) - 1:
        after = np.zeros(len(parse), "i8")
        after[: len(parse) - done] = rank[done:] + 1
        rank = np.unique(rank * (len(parse) + 2) + after, return_inverse=True)[1].astype("i8")
        done *= 2
    return rank


def repeated_places(pieces: list[bytes], shard_of: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its stretches start elsewhere in pieces of the same shard too: a mask of their starts."""
    text = np.frombuffer(b"".join(pieces), "u1")
    lengths = np.array([len(x) for x in pieces])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    # Phrases end with triggers and with pieces, and begin with the trigger before.
    fits = np.flatnonzero((rolling(text, TRIGGER) >> np.uint64(40)) % ODDS == 0) + TRIGGER if len(text) >= TRIGGER else np.zeros(0, "i8")
    piece = np.searchsorted(ends, fits - 1, "right")
    fits = fits[(fits - TRIGGER >= begins[piece]) & (fits < ends[piece])]
    stops = np.sort(np.concatenate([fits, ends]))
    owner = np.searchsorted(ends, stops - 1, "right")
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    before = np.concatenate([[0], stops[:-1]])
    starts = np.where(first, begins[owner], before - TRIGGER)
    raw = text.tobytes()
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    sizes = np.array([len(x) for x in numbers])
    to = np.cumsum(sizes)
    dictionary = word_ranks(np.frombuffer(b"".join(numbers), "u1"), to - sizes, to)
    # The parse: phrases by rank, each piece followed by a 0.
    at = np.arange(len(which)) + owner
    parse = np.zeros(len(which) + len(pieces), "i8")
    parse[at] = dictionary[(to - sizes)[which]] + 1
    behind = parse_ranks(parse, length)
    # Every stretch's place: the rest of its phrase, then the parse behind it.
    counts = np.maximum(lengths - length + 1, 0)
    places = np.arange(int(counts.sum())) + np.repeat(begins - np.cumsum(counts) + counts, counts)
    phrase = np.searchsorted(np.where(np.append(owner[1:] != owner[:-1], True), stops, stops - TRIGGER), places, "right")
    rest = dictionary[(to - sizes)[which[phrase]] + places - starts[phrase]]
    shards = np.unique(np.array(shard_of), return_inverse=True)[1][np.repeat(np.arange(len(pieces)), counts)]
    order = np.lexsort((behind[at[phrase] + 1], rest, shards))
    ordered = places[order]
    h = rolling(text, length) if len(text) >= length else np.zeros(0, "u8")
    alike = (h[ordered[1:]] == h[ordered[:-1]]) & (shards[order][1:] == shards[order][:-1])
    windows, check = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None, np.flatnonzero(alike)
    for k in range(0, len(check), 2048):
        some = check[k : k + 2048]
        alike[some] = (windows[ordered[some]] == windows[ordered[some + 1]]).all(axis=1)
    found = np.zeros(len(places), bool)
    found[order[1:][alike]] = True
    found[order[:-1][alike]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true as (first, behind last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("i1"), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the two numbers that stand for a document: its id and a hash of text and missing id."""
    i = F.col(id_col).cast("long")
    return df.select("*", F.coalesce(i, F.lit(0)).alias("_k1"), F.xxhash64(i.isNull(), F.coalesce(F.col(text_col), F.lit(""))).alias("_k2"))


def _segment_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        cols: list[list] = [[] for _ in range(8)]

        def rows() -> pa.RecordBatch:
            shard, d1, d2, k1, k2, start, end, again = cols
            unsigned = lambda x: pa.array(np.array(x, "u8").view("i8"))
            out = pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), unsigned(d1), unsigned(d2), *[pa.array(x, pa.int64()) for x in (k1, k2, start, end)], pa.array(again, pa.bool_())], names=["shard", "d1", "d2", "k1", "k2", "start", "end", "again"])
            for x in cols:
                x.clear()
            return out

        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for shard, start, end, again in segments_of(data) if len(data) >= LENGTH else ():
                    d = digest(data[start:end])
                    for col, x in zip(cols, (shard, d >> 64, d & 0xFFFFFFFFFFFFFFFF, k1, k2, start, end, again), strict=True):
                        col.append(x)
                if len(cols[0]) >= 1 << 16:
                    yield rows()
        if cols[0]:
            yield rows()

    return docs.mapInArrow(run, "shard long, d1 long, d2 long, k1 long, k2 long, start long, end long, again boolean")


def _sorted_shards(rows: DataFrame, tasks: int) -> DataFrame:
    """(shard, d1, d2, first, last): runs of repeated stretches of each segment, from the corpus order of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def result() -> pa.RecordBatch:
            masks = repeated_places([x[3] for x in held], [x[0] for x in held])
            out = [(*x[:3], a, b) for x, mask in zip(held, masks, strict=True) for a, b in runs_of(mask)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["shard", "d1", "d2", "first", "last"])

        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # the same segment of a repeated row
                if size >= BATCH_BYTES and row[0] != held[-1][0]:
                    yield result()
                    size = 0
                held.append(row)
                size += len(row[3])
        if held:
            yield result()

    placed = rows.select("shard", "d1", "d2", "bytes").repartition(tasks, "shard").sortWithinPartitions("shard", "d1", "d2")
    return placed.mapInArrow(run, "shard long, d1 long, d2 long, first long, last long")


def _crowded_shards(rows: DataFrame) -> DataFrame:
    """The same for shards too large for a task: stretches meet by digest, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for shard, d1, d2, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                n = len(data) - LENGTH + 1
                ds = [digest(data[i : i + LENGTH]) for i in range(n)]
                high, low = (np.array([f(x) for x in ds], "u8").view("i8") for f in (lambda x: x >> 64, lambda x: x & 0xFFFFFFFFFFFFFFFF))
                same = [pa.array(np.full(n, x, "i8")) for x in (shard, d1, d2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(high), pa.array(low), pa.array(np.arange(n))], names=["shard", "d1", "d2", "w1", "w2", "first"])

    each = rows.select("shard", "d1", "d2", "bytes").dropDuplicates(["shard", "d1", "d2"]).mapInArrow(run, "shard long, d1 long, d2 long, w1 long, w2 long, first long")
    often = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"))
    hit = each.join(often, (each["w1"] == often["_w1"]) & (each["w2"] == often["_w2"]))
    # Stretches in a row have one difference of start and number, so a run is one row.
    number = F.row_number().over(Window.partitionBy("shard", "d1", "d2").orderBy("first"))
    runs = hit.withColumn("_run", F.col("first") - number).groupBy("shard", "d1", "d2", "_run")
    return runs.agg(F.min("first").alias("first"), (F.max("first") + 1).alias("last")).drop("_run")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each document with any, the sorted spans (start, end) of bytes covered by repeated stretches.

    k1 and k2 are the document's id and a hash of its text; rows that repeat both are copies of each other.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = _keyed(own, "id", "text").select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    folder = fresh_folder(df.sparkSession, "segments")
    _segment_rows(docs).write.parquet(folder)
    segments = df.sparkSession.read.parquet(folder)

    # Shards of one segment, without a string of it twice, have no repeated stretch.
    live = segments.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("again").cast("int")).alias("a")).where("n > 1 or a = 1").select(F.col("shard").alias("_shard"))
    # Both sides of a join by shard are stored tables, so that Spark may split the partition of a hot one.
    live = cut(live)
    members = cut(segments.join(live, segments["shard"] == live["_shard"], "left_semi"))
    kinds = members.groupBy("shard", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("k1", "k2", "start", "end")).alias("at"), F.max(F.col("again").cast("int")).alias("again"))
    kinds = cut(kinds.select("shard", "d1", "d2", "n", "again", F.col("at.k1").alias("r1"), F.col("at.k2").alias("r2"), "at.start", "at.end"))
    shards = kinds.groupBy("shard").agg(F.count(F.lit(1)).alias("n_kinds"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.max("again").alias("any_again")).where("n_kinds > 1 or any_again = 1")
    shards = cut(shards.select(F.col("shard").alias("_shard"), "n_bytes"))
    # Only segments that differ from others of their shard are compared; one document gives the bytes of each.
    wanted = kinds.join(shards, kinds["shard"] == shards["_shard"]).select("shard", "d1", "d2", "r1", "r2", "start", "end", "n_bytes")
    asked = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("shard", "d1", "d2", "start", "end", "n_bytes")).alias("asked"))
    given = docs.join(asked, (docs["k1"] == asked["r1"]) & (docs["k2"] == asked["r2"]))
    part = lambda x: F.substring(F.col("text").cast("binary"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    parts = F.transform("asked", lambda x: F.struct(x["shard"].alias("shard"), x["d1"].alias("d1"), x["d2"].alias("d2"), x["n_bytes"].alias("n_bytes"), part(x).alias("bytes")))
    given = cut(given.select(F.inline(parts)))
    size = shards.where(F.col("n_bytes") <= MOST_BYTES).agg(F.sum("n_bytes")).first()[0] or 0
    tasks = min(MOST_TASKS, max(df.sparkSession.sparkContext.defaultParallelism, int(size) // TASK_BYTES))
    found = _sorted_shards(given.where(F.col("n_bytes") <= MOST_BYTES), tasks).unionByName(_crowded_shards(given.where(F.col("n_bytes") > MOST_BYTES)))
    whole = kinds.where("n > 1").select("shard", "d1", "d2", F.lit(0).cast("long").alias("first"), (F.col("end") - F.col("start") - (LENGTH - 1)).alias("last"))
    found = found.unionByName(whole).select(F.col("shard").alias("_s"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "first", "last")
    met = members.join(found, (members["shard"] == found["_s"]) & (members["d1"] == found["_d1"]) & (members["d2"] == found["_d2"]))
    spans = met.select("k1", "k2", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LENGTH - 1).alias("b"))
    return merged(spans)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (k1, k2, a, b) of a document as one."""
    w = Window.partitionBy("k1", "k2").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.distinct().withColumn("_new", F.when(F.col("a") <= reach, 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = x.groupBy("k1", "k2", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return one.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _with_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(df, id_col, text_col).select(F.col("k1").alias("_s1"), F.col("k2").alias("_s2"), F.col("spans").alias("_spans"))
    rows = _keyed(df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    return rows.join(spans, (rows["_k1"] == spans["_s1"]) & (rows["_k2"] == spans["_s2"]), "left")


def kept_bytes(data: bytes, spans) -> bytes:
    kept, at = [], 0
    for x in spans if spans is not None else ():
        kept.append(data[at : x["a"]])
        at = x["b"]
    return b"".join([*kept, data[at:]])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every byte of a text gone that is covered by LENGTH bytes which start anywhere else too.

    Texts are UTF-8; matches never cross documents; strings are judged on the input. Null texts stay null, and
    characters of which bytes are left over are dropped. Rows that repeat others entirely lose all their bytes, if
    they have LENGTH or more. An empty table gives an empty result. Has the columns of ``df``.
    """

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([x if x is None or s is None else kept_bytes(x.encode("utf-8", "surrogatepass"), s).decode("utf-8", "ignore") for x, s in zip(texts, spans, strict=True)], dtype="object")

    met = _with_spans(df, id_col, text_col)
    return met.select(*[clean("_text", "_spans").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (whether bytes were removed) of every row. Null texts
    are empty; rows that repeat others wholly lose all bytes if they have LENGTH; an empty table gives no rows."""
    met = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")

    @F.pandas_udf("string")
    def sha(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([hashlib.sha256(kept_bytes((x or "").encode("utf-8", "surrogatepass"), s)).hexdigest() for x, s in zip(texts, spans, strict=True)])

    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return met.select(
        F.col("_row.doc_id").alias("doc_id"), F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_spans"), sha("_text", "_spans").alias("kept_sha256"), F.col("_spans").isNotNull().alias("repeated"),
    )
