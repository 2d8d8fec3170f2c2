"""Spelling variants: words one letter apart, found by pivotal bigrams.

Bigrams are ordered by how many words have them, rare ones first. A word's prefix is its three first bigrams in that
order (two letters times one edit, plus one), with all places where these occur; its pivots are two bigrams of the
prefix that do not overlap, the rarest such pair, chosen by dynamic programming over their places.

One edit spoils at most one of two disjoint pivots. Of two words one edit apart take the one whose prefix ends earlier in
the order: a pivot of it that is not spoilt is also in the other word's prefix. The edit lies wholly to one side of that
bigram, so on the other side both words are alike to their end, and that side also fixes the bigram's place. Pivots are
therefore looked up by the bigram together with what lies before it, and again with what lies behind it, among prefixes
of words at most one letter longer or shorter; of the letters on the side of the edit, the half next to the bigram or the
half at the word's end is alike too, and is part of the key. Pairs that meet are verified.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Letters of words, once A-Z are lower case: 26 and the 64 of U+00C0 to U+00FF, so there are at most 8,100 bigrams.
LETTERS = "a-zÀ-ÿ"
TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are this long and occur this often at least.
MIN_LETTERS, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
FORM_FACTOR = 5
#: One in so many (document, word) pairs loses a letter.
DAMAGED = 199
#: Different words, and letters of these, that a task holds before it passes its counts on.
HELD_WORDS, HELD_LETTERS = 300_000, 30_000_000
#: Prefix hashes of words are taken modulo a prime.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def damaged(doc_id: str, run: str, one_in: int = DAMAGED) -> str:
    """The word as the document has it: where the checksum of both says so, one letter is missing."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(least: int, one_in: int):
    """(id, text) rows to (word, n), added up over as many texts as fit in bounded memory."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # a shorter run has no word

    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (data := text.as_py()):
                    continue
                own = Counter(runs.findall(data.encode().translate(TO_LOWER).decode()))
                for run, n in own.items():
                    word = damaged(doc_id, run, one_in)
                    if len(word) >= least:
                        if word not in held:
                            letters += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield emit(held)
                    held, letters = Counter(), 0
        if held:
            yield emit(held)

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS, often: int = MIN_COUNT, one_in: int = DAMAGED) -> DataFrame:
    """(word, n): the words of ``least`` letters or more that occur ``often`` times or more in all texts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_counter(least, one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of the task have each bigram."""
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            held.update({word[k : k + 2] for k in range(len(word) - 1)})
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])


def pivots_of(places: list[tuple[int, int]]) -> tuple[int, int]:
    """Of (place, weight) in order of place, the two places at least two letters apart of the least weight together."""
    best = None
    least, ahead = None, 0  # the lightest bigram that ends before the one looked at, and the next to enter
    for place, weight in places:
        while places[ahead][0] <= place - 2:
            if least is None or places[ahead][1] < least[1]:
                least = places[ahead]
            ahead += 1
        if least is not None and (best is None or least[1] + weight < best[0]):
            best = (least[1] + weight, least[0], place)
    return best[1:]


def keys_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[set[int], set[int]]:
    """What a word is looked up by, and what it is found by. ``order`` has a rank and a weight for each bigram.

    A key has the letters of a word from one end up to a bigram and, of the letters beyond it, those next to it or those
    at the other end: half as many as the shorter of two words has there, so that one edit spares the ones or the others.
    """
    size = len(word)
    ranks = [order[word[k : k + 2]] for k in range(size - 1)]
    last = heapq.nsmallest(3, ranks)[-1][0]
    prefix = [(k, weight) for k, (rank, weight) in enumerate(ranks) if rank <= last]
    upto, onward, h = [0], [0], 0
    for c in word:
        h = (h * BASE + ord(c)) % PRIME
        upto.append(h)
    h = 0
    for c in reversed(word):
        h = (h * BASE + ord(c)) % PRIME
        onward.append(h)

    def both(k: int, letters: int, shorter: int) -> Iterator[int]:
        """Keys of the bigram at k towards words of so many letters; ``shorter`` letters fewer than ``word``, or 0."""
        for side, there, here, alike in ((1, upto, onward, k + 2), (2, onward, upto, size - k)):
            half = (size - shorter - alike) // 2
            if half >= 0:
                yield hash((side, letters, alike, half, there[alike + half]))
                yield hash((side + 2, letters, alike, half, there[alike], here[half]))

    asked = {x for k in pivots_of(prefix) for d in (-1, 0, 1) for x in both(k, size + d, -min(d, 0))}
    return asked, {x for k, _ in prefix for shorter in (0, 1) for x in both(k, size, shorter)}


def _index(shared, pivots: bool):
    """(word) rows to (key, word_id, odd): one side of the index. ``odd`` tells which letters a word has an odd number of."""
    import xxhash

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value

        def emit(*columns: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "word_id", "odd"])

        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            keys, ids, odds = [], [], []
            for word in batch.column(0).to_pylist():
                own, odd = keys_of(word, order)[0 if pivots else 1], 0
                for c in word:
                    odd ^= 1 << (ord(c) & 63)
                keys += own
                ids += [signed(xxhash.xxh64_intdigest(word.encode(), 42))] * len(own)
                odds += [signed(odd)] * len(own)
                if len(keys) > 200_000:
                    yield emit(keys, ids, odds)
                    keys, ids, odds = [], [], []
            yield emit(keys, ids, odds)

    return index


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two words one inserted, deleted or replaced letter apart, in both directions.

    ``words`` is a stored table of (word, n) with distinct words of three letters or more.
    """
    grams = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 8,100 rows
    ranked = sorted(grams, key=lambda r: (r["n"], r["gram"]))
    shared = words.sparkSession.sparkContext.broadcast({r["gram"]: (k, r["n"]) for k, r in enumerate(ranked)})
    side = lambda pivots, x: words.select("word").mapInArrow(_index(shared, pivots), f"key long, {x} long, {x}_odd long")
    met = side(True, "a").join(side(False, "b"), "key").where("a <> b and bit_count(a_odd ^ b_odd) <= 2")  # as one edit leaves it
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = lambda x: words.select(F.xxhash64("word").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    pairs = met.join(named("a"), "a").join(named("b"), "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    pairs = cut(pairs.select("a_word", "a_n", "b_word", "b_n"))
    names = ["word", "n", "near", "near_n"]
    return pairs.toDF(*names).unionByName(pairs.select("b_word", "b_n", "a_word", "a_n").toDF(*names))


def spelling_forms(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Every (word, n) with n_near, form, form_n and root.

    A form is the most frequent near word, the first in code-point order among equals, if it occurs ``factor`` times as
    often as the word or more; root is what following forms ends at. Counts grow by the factor with each form, so there
    are few steps. An empty table gives an empty result. ``words`` is a stored table with distinct words.
    """
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near"))).alias("best"))
    out = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    fits = -F.col("best.down") >= factor * F.col("n")
    out = cut(out.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.down")).alias("form_n")))
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, factor)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = cut(roots.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all documents; see ``word_counts`` and ``spelling_forms``.

    Null texts have no words, a null doc_id counts as ``null``, rows that repeat others count again.
    """
    return spelling_forms(cut(word_counts(table(spark, sf_dir, "documents"))))


#: CRC-32 by half bytes, low one first; near words meet by what is left when a letter goes.
SQL = r"""
WITH halves AS MATERIALIZED (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), own AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
digits AS (SELECT doc, run, n, list_transform(string_split(hex(encode(doc || ':' || run)), ''), lambda x: (ascii(x) - CASE WHEN ascii(x) > 57 THEN 55 ELSE 48 END)::BIGINT) AS a FROM own),
swapped AS (SELECT doc, run, n, list_transform(range(len(a)), lambda i: a[xor(i, 1) + 1]) AS a FROM digits),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, a), lambda x, y: xor(x >> 4, t[(xor(x, y) & 15) + 1])), 4294967295) AS h FROM swapped, halves),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, encode(p.near))) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS MATERIALIZED (
  WITH RECURSIVE up AS (SELECT word, word AS reached, 0 AS k FROM formed UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN formed f ON f.word = up.reached WHERE f.form IS NOT NULL)
  SELECT word, arg_max(reached, k) AS root FROM up GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
