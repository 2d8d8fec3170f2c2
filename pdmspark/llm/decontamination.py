"""Benchmark decontamination with suffix arrays of the training text.

A shard (an Arrow batch of documents) is turned into word numbers of the benchmark's vocabulary. Stretches
without a word outside it, long enough for a match, make up the shard's suffix array, sorted by prefix
doubling. Each suffix of a benchmark item is searched in it by bisection, all at once; the entries that begin
with the item's window are its occurrences, and occurrences in a row make the longest verbatim matches.

Which words of a document are hit, and by which items, follows from the windows that occur, in time and memory in
proportion to the texts. The list of all matches pairs every place in a document with every place in an item, which
is much where both repeat themselves; it is made on request only.

The benchmark is searched in blocks of bounded size. One block is one pass over the documents. Of several, each is read,
broadcast, searched, its hits stored and its broadcast destroyed before the next, so memory is that of one block whatever
the benchmark's size, and the stored documents are read once a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, cut, fresh_folder, table, unboxed

WINDOW = 13
#: A block holds about this many bytes of benchmark text, and at least one item.
BLOCK_BYTES = 4_000_000
#: Bytes of words: ASCII letters, made lower case, digits, and all of characters beyond ASCII. The rest separates.
TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a document that are matched, as n_words / n_hit, make it contaminated from one in so many on.
HIT_SHARE = 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Block:
    """Some benchmark items: their word numbers (from 1) and windows by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.names = [name for name, _ in items]
        words = [words_of(text) for _, text in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}), 1)}
        numbers = [np.array([self.vocabulary[w] for w in ws], "i4") for ws in words]
        #: By length: the distinct windows, one a row, and (window, item, first word in the item) of each place.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for item, x in enumerate(numbers):
            n = min(len(x), window)
            for at in range(len(x) - n + 1) if n else ():
                by_length.setdefault(n, []).append((item, at, x[at : at + n]))
        for n, found in by_length.items():
            rows, which = np.unique(np.stack([x for _, _, x in found]), axis=0, return_inverse=True)
            places = np.array([(w, item, at) for w, (item, at, _) in zip(which.reshape(-1).tolist(), found, strict=True)], "i8")
            self.windows[n] = rows, places[np.argsort(places[:, 0], kind="stable")]
        #: By length: the distinct (window, item), in order.
        self.items = {n: np.unique(places[:, :2], axis=0) for n, (_, places) in self.windows.items()}
        self.shortest = min(self.windows, default=0)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order of their first ``depth`` numbers, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype("i8") + 1
    done = 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        after = np.zeros(n, "i8")
        after[: n - done] = rank[done:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, "i8")
        new[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank, done = new, 2 * done
        if rank[order[-1]] == n:
            break
    return order


def bisect(text: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row) the range of ``order`` whose suffixes begin with it. ``text`` ends with enough zeros."""
    width = np.arange(patterns.shape[1])

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(patterns), "i8"), np.full(len(patterns), len(order), "i8")
        while (open_ := low < high).any():
            middle = (low + high) // 2
            differ = text[order[np.minimum(middle, len(order) - 1)][:, None] + width] - patterns
            first = np.argmax(differ != 0, axis=1)
            sign = differ[np.arange(len(differ)), first]
            right = (sign <= 0) if upper else (sign < 0)
            low, high = np.where(open_ & right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    return bound(False), bound(True)


class Shard:
    """Documents as word numbers, their suffix array, and the search of a block in it."""

    def __init__(self, texts: list[str | None], block: Block) -> None:
        self.block = block
        get = block.vocabulary.get
        # A text at a time: its words take far more memory than their numbers.
        numbers = [np.fromiter(map(get, words_of(x), repeat(0)), "i4") for x in texts]
        self.counts = np.fromiter(map(len, numbers), "i8", len(numbers))
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        self.text, self.places = self._stretches(np.concatenate([*numbers, np.zeros(0, "i4")]))

    def _stretches(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of known words within a document, each followed by a 0, and the place of each entry."""
        known = numbers > 0
        cuts = np.zeros(len(numbers) + 1, bool)
        cuts[self.begins] = True
        starts = np.flatnonzero(known & (cuts[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (cuts[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = (ends - starts >= self.block.shortest) & (self.block.shortest > 0)
        starts, lengths = starts[long], (ends - starts)[long]
        total = int((lengths + 1).sum())
        text, places = np.zeros(total + self.block.window, "i4"), np.full(total, -1, "i8")
        to = np.cumsum(lengths + 1) - lengths - 1
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, source = np.repeat(to, lengths) + inside, np.repeat(starts, lengths) + inside
        text[at], places[at] = numbers[source], source
        return text, places

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, word, window) for each length of windows: where in the shard which of them occurs."""
        if not len(self.places):
            return
        order = suffix_array(self.text[: len(self.places)], self.block.window)
        for n, (patterns, _) in self.block.windows.items():
            low, high = bisect(self.text, order, patterns)
            hit = np.flatnonzero(high > low)
            sizes = (high - low)[hit]
            entries = np.repeat(low[hit], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield n, self.places[order[entries]], np.repeat(hit, sizes)

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, word, "right") - 1

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Which words of the shard are hit, as a mask, and the distinct (document, item), one a row."""
        edges, pairs = np.zeros(len(self.begins) and int(self.begins[-1]) + 1, "i4"), [np.zeros(0, "i8")]
        items = max(len(self.block.names), 1)
        for n, word, window in self.windows():
            np.add.at(edges, word, 1)
            np.add.at(edges, word + n, -1)
            kinds = len(self.block.windows[n][0])
            seen = np.sort(self.document(word) * kinds + window)
            seen = seen[np.diff(seen, prepend=-1) != 0]
            doc, window = seen // kinds, seen % kinds
            # The distinct items of each window, once for each document that has it.
            owned = self.block.items[n]
            first, last = np.searchsorted(owned[:, 0], window, "left"), np.searchsorted(owned[:, 0], window, "right")
            each = last - first
            entry = np.repeat(first, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            found = np.sort(np.repeat(doc, each) * items + owned[entry, 1])
            pairs.append(found[np.diff(found, prepend=-1) != 0])
        found = np.sort(np.concatenate(pairs))
        found = found[np.diff(found, prepend=-1) != 0]
        return np.cumsum(edges)[:-1] > 0, np.stack([found // items, found % items], axis=1)

    def occurrences(self) -> np.ndarray:
        """Rows (document, first word, item, first word in the item, number of words) of all window occurrences."""
        found = [np.zeros((0, 5), "i8")]
        for n, word, pattern in self.windows():
            where = self.block.windows[n][1]
            first, last = np.searchsorted(where[:, 0], pattern, "left"), np.searchsorted(where[:, 0], pattern, "right")
            each = last - first
            entry = np.repeat(first, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            word = np.repeat(word, each)
            doc = self.document(word)
            found.append(np.stack([doc, word - self.begins[doc], where[entry, 1], where[entry, 2], np.full(len(word), n)], axis=1))
        return np.concatenate(found)


def longest(found: np.ndarray) -> np.ndarray:
    """Occurrences in a row, of one item in one document, as one verbatim match each."""
    if not len(found):
        return found
    shift = found[:, 1] - found[:, 3]
    order = np.lexsort((found[:, 1], shift, found[:, 2], found[:, 0]))
    found, shift = found[order], shift[order]
    new = np.concatenate([[True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 2]) != 0) | (np.diff(shift) != 0) | (np.diff(found[:, 1]) != 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(found)]]) - 1
    out = found[begin]
    out[:, 4] = found[end, 1] + found[end, 4] - found[begin, 1]
    return out


MATCHES = "n_words long, matches array<struct<doc_start long, item_id string, item_start long, n_words long>>"


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks of the benchmark, and the blocks, each read when it is asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), text.alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES
    parts = (rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return n, (Block([(r["id"], r["text"]) for r in part.collect()], window) for part in parts)


HITS = "n_words long, spans array<struct<a long, b long>>, items array<string>"


def _matcher(shared):
    """All matches of one broadcast block, over Arrow batches of texts."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            shard = Shard(texts.tolist(), shared.value)
            found = longest(shard.occurrences())
            cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            ids = shared.value.names
            rows = [
                [{"doc_start": a, "item_id": ids[i], "item_start": s, "n_words": n} for _, a, i, s, n in found[x:y].tolist()] if x < y else []
                for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)
            ]
            yield pd.DataFrame({"n_words": shard.counts, "matches": rows})

    return search


def _hitter(shared):
    """The spans of words hit by one broadcast block, and the items that hit, over Arrow batches of texts."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            shard = Shard(texts.tolist(), shared.value)
            mask, pairs = shard.hits()
            spans, items = [[] for _ in texts], [[] for _ in texts]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("i1"), [0]])))
            for a, b in edges.reshape(-1, 2).tolist():  # a run of hit words may go on in the next document
                doc = int(shard.document(np.array([a]))[0])
                while a < b:
                    begin, end = int(shard.begins[doc]), int(shard.begins[doc + 1])
                    if a < end:
                        spans[doc].append({"a": a - begin, "b": min(b, end) - begin})
                        a = min(b, end)
                    doc += 1
            for doc, item in pairs.tolist():
                items[doc].append(shared.value.names[item])
            yield pd.DataFrame({"n_words": shard.counts, "spans": spans, "items": items})

    return search


def _searched(df: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, search, kind: str) -> DataFrame:
    """``df`` with ``_found``: n_words and, for each list of ``kind``, that of all blocks of the benchmark together."""
    spark = df.sparkSession
    n, blocks = _blocks(items, item_id, item_text, window)
    if n == 1:
        shared = spark.sparkContext.broadcast(next(blocks))  # bounded by BLOCK_BYTES
        return df.withColumn("_found", F.pandas_udf(search(shared), kind)(F.col(text_col)))
    folder, hits = fresh_folder(spark, "decontamination-rows"), fresh_folder(spark, "decontamination-hits")
    df.withColumn("_place", F.monotonically_increasing_id()).write.parquet(folder)
    held = spark.read.parquet(folder)
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES
        found = held.select("_place", F.pandas_udf(search(shared), kind)(F.col(text_col)).alias("_found")).select("_place", "_found.*")
        # The first block tells the number of words of every document, the others of those with hits alone.
        (found if k == 0 else found.where(F.size(found.columns[-1]) > 0)).write.mode("append").parquet(hits)
        shared.destroy()
        del block
    found = spark.read.parquet(hits)
    n_words, lists = F.max("n_words").alias("n_words"), [F.flatten(F.collect_list(c)).alias(c) for c in found.columns[2:]]
    each = found.groupBy("_place").agg(n_words, *lists)
    return held.join(each.select("_place", F.struct(*found.columns[1:]).alias("_found")), "_place").drop("_place")


def find_matches(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words and matches: all longest verbatim matches of ``window`` words or more with benchmark items.

    A match tells the item and the first word of the match in the document and in the item. An item of fewer
    words, but not none, is matched as a whole; null and empty texts have no words. Matches never cross
    documents. An empty benchmark gives no matches. A benchmark of several blocks is searched when this is called.
    """
    out = _searched(df.drop("n_words", "matches"), items, text_col, item_id, item_text, window, _matcher, MATCHES)
    return out.withColumns({"n_words": F.col("_found.n_words"), "matches": F.col("_found.matches")}).drop("_found")


def find_hits(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words, n_hit, items (the ids, sorted as strings) and contaminated: what matches hit, without the matches.

    n_hit counts a word once, however many matches cover it. Rows of one item id count as one item. Columns of df with
    these names are replaced. For the rest see ``find_matches``.
    """
    out = _searched(df.drop("n_words", "n_hit", "items", "contaminated"), items, text_col, item_id, item_text, window, _hitter, HITS)
    spans = F.array_sort("_found.spans")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        spans, start, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(x["b"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("n"))
    )
    out = out.withColumns({"n_words": F.col("_found.n_words"), "n_hit": covered["n"], "items": F.array_sort(F.array_distinct("_found.items"))}).drop("_found")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated, with the columns of ``df``."""
    held = boxed(df, F.col(text_col).alias("text"))
    return unboxed(find_hits(held, items).where(~F.col("contaminated")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row; see ``find_hits``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_hits(docs, table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bn AS (
  SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS piece FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM bn)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS piece
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.piece = bw.piece
), covered AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""
