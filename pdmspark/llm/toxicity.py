"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams that it has, hashed to ``DIM`` buckets. Counting over
labelled texts gives each bucket's log ratio of its shares of the toxic and of the other texts' n-grams;
logistic regression is fitted on the buckets that differ most, each scaled by its ratio.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, seeded_hash, table, unboxed

#: Lengths of n-grams, buckets, and buckets that the regression uses.
LENGTHS = (4, 5, 6)
BITS = 20
DIM = 1 << BITS
SELECTED = 4096
#: At most this many labelled rows are used for fitting, chosen by a seeded hash of the id.
MAX_TRAIN = 12_000
#: Ids with over this part of them come after all others.
MOST_OF_AN_ID = 100
THRESHOLD = 0.3
SEED = "tox-1"
#: Rows of the sums of counts: each has DIM / BLOCKS buckets.
BLOCKS = 64
#: Characters that are hashed at a time: their codes, hashes and places take some 100 bytes each.
CHUNK = 1 << 18


def _plain() -> np.ndarray:
    """ASCII codes with all but letters and digits made blank."""
    keep = np.zeros(128, bool)
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        keep[ord(a) : ord(b) + 1] = True
    return np.where(keep, np.arange(128), 32).astype("u4")


def _buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, the bucket of the n-gram at each place) for each length of n-grams; codes are characters."""
    plain, wide = _plain(), codes.astype("u8")
    ascii_ = codes < 128
    wide[ascii_] = plain[codes[ascii_]]
    h = wide
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
        if n in LENGTHS and len(h):
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield n, (mixed >> np.uint64(64 - BITS)).astype("i4")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")


def gram_hits(texts: Sequence[str | None], wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the distinct n-grams of each text in lower case, of ``wanted`` buckets only if given.

    Parts hold whole texts, in order, of some CHUNK characters; a longer text is a part alone, hashed in stretches
    that overlap, so memory does not follow the length of texts.
    """
    for begin, piece in _pieces(texts):
        if len(piece) == 1 and len(piece[0]) > CHUNK:
            has, text, step = np.zeros(DIM, bool), f" {piece[0].lower()} ", CHUNK
            for at in range(0, len(text), step):
                for _, bucket in _buckets(_codes(text[at : at + step + max(LENGTHS) - 1])):
                    has[bucket] = True
            found = np.flatnonzero(has if wanted is None else has & wanted)
            yield np.full(len(found), begin), found
            continue
        padded = [f" {x.lower()} " for x in piece]
        ends, hits = np.cumsum([len(x) for x in padded]), []
        for n, bucket in _buckets(_codes("".join(padded))):
            at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
            text = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[text]
            hits.append((text[inside] << BITS) | bucket[at[inside]])
        pairs = np.sort(np.concatenate([*hits, np.zeros(0, "i8")]))
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        yield (pairs >> BITS) + begin, pairs & (DIM - 1)


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts that follow each other, with the number of the first: CHUNK characters at most, or one longer text."""
    held: list[str] = []
    size = 0
    for i, x in enumerate(texts):
        x = x or ""
        if held and size + len(x) > CHUNK:
            yield i - len(held), held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield len(texts) - len(held), held


class Model:
    """weights by bucket, 0 where the regression has none; ``blank`` is the score of a text without features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype("f4"), bias

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        total, wanted = np.full(len(texts), self.bias), self.weights != 0
        for text, bucket in gram_hits(texts, wanted):
            total += np.bincount(text, self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def training_rows(df: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, y) of at most ``max_train`` labelled rows. Of several labels of an id the highest counts; rows that repeat
    an id are all used or none, so reruns agree."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    y = y.where(may_learn).select(F.col(id_col).alias("_id"), "_y")
    ids = df.select(F.col(id_col).alias("_key")).join(y, F.col("_key") == F.col("_id"), "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    # Ids by hash, as long as their rows fit; those with very many rows come last, so that they cost no other id its label.
    order = [F.col("_rows") > max(1, max_train // MOST_OF_AN_ID), seeded_hash(SEED, "_key"), F.col("_key")]
    ids = ids.orderBy(*order).limit(max_train)
    fit = F.sum("_rows").over(Window.orderBy(*order)) <= max_train
    ids = ids.withColumn("_fit", fit).where("_fit").select(F.col("_key").alias("_chosen"))
    y = y.join(F.broadcast(ids), F.col("_id") == F.col("_chosen"))  # max_train ids at most
    return df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(F.broadcast(y), F.col("_key") == F.col("_id")).select("text", F.col("_y").alias("y"))


def fit(rows: DataFrame) -> Model:
    """Fits on (text, y). Sums of counts (DIM pairs) and the selected features of the rows come to the driver."""
    rows = cut(rows.repartition(12))
    width = DIM // BLOCKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, DIM), "i8")
        for batch in batches:
            y = batch["y"].to_numpy()
            for text, bucket in gram_hits(batch["text"], None):
                for k in (0, 1):
                    sums[k] += np.bincount(bucket[y[text] == k], minlength=DIM)
        yield pd.DataFrame({"block": np.arange(BLOCKS), "none": [x.tobytes() for x in sums[0].reshape(BLOCKS, width)], "toxic": [x.tobytes() for x in sums[1].reshape(BLOCKS, width)]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = {k: np.sum([np.frombuffer(x, "i8") for x in parts[k]], axis=0).tobytes() for k in ("none", "toxic")}
        return pd.DataFrame([{"block": parts["block"].iloc[0], **total}])

    kind = "block int, none binary, toxic binary"
    blocks = sorted(rows.mapInPandas(count, kind).groupBy("block").applyInPandas(add, kind).collect(), key=lambda r: r["block"])
    labelled = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_none = labelled.get(1, 0), labelled.get(0, 0)
    if not n_toxic:  # nothing is known of toxic texts, so none is called so
        return Model(np.zeros(DIM), -40.0)
    none, toxic = (np.concatenate([np.frombuffer(r[k], "i8") for r in blocks]).astype("f8") for k in ("none", "toxic"))
    ratio = np.log((toxic + 1) / (toxic + 1).sum()) - np.log((none + 1) / (none + 1).sum())
    sure = np.where(toxic + none >= 3, np.abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (none + 1)), 0)
    chosen = np.sort(np.argsort(-sure, kind="stable")[:SELECTED])
    chosen = chosen[sure[chosen] > 0]
    wanted, place = np.zeros(DIM, bool), np.zeros(DIM, "<u2")
    wanted[chosen], place[chosen] = True, np.arange(len(chosen))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [b""] * len(batch)
            for text, bucket in gram_hits(batch["text"], wanted):
                names, begins = np.unique(text, return_index=True)
                for k, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(text)], strict=False):
                    grams[k] = place[bucket[a:b]].tobytes()
            yield pd.DataFrame({"y": batch["y"], "grams": grams})

    sparse = rows.mapInPandas(features, "y int, grams binary").collect()
    y = np.array([r["y"] for r in sparse], "f8")
    lengths = np.array([len(r["grams"]) // 2 for r in sparse], "i8")
    grams = np.frombuffer(b"".join([r["grams"] for r in sparse]), "<u2")
    del sparse, none, toxic, sure, wanted
    weights, bias = regress(grams, lengths, y, ratio, chosen)
    return Model(weights, bias)


def regress(grams: np.ndarray, lengths: np.ndarray, y: np.ndarray, ratio: np.ndarray, chosen: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the chosen buckets, scaled by their ratios; full gradient steps with adapted rates.

    ``grams`` has the texts' features one after the other, ``lengths`` of each text, as places in ``chosen``; they
    are gone through in blocks, so that little memory is needed beside them.
    """
    scale, ends = ratio[chosen], np.concatenate([[0], np.cumsum(lengths)])
    w, bias = np.zeros(len(chosen)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m = v = np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        g, weights = np.zeros(len(chosen) + 1), scale * w
        for at in range(0, len(y), 256):
            to = min(at + 256, len(y))
            cols, row = grams[ends[at] : ends[to]], np.repeat(np.arange(to - at), lengths[at:to])
            z = bias + np.bincount(row, weights[cols], minlength=to - at)
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at:to]
            g[:-1] += np.bincount(cols, err[row], minlength=len(w))
            g[-1] += err.sum()
        g = np.append(scale * g[:-1] / len(y) + ridge * w, g[-1] / len(y))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(DIM)
    out[chosen] = w * scale
    return out, float(bias)


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with each whole text's score, 0 to 1. Null and empty texts get the score of a text without n-grams known."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM floats: 4 MB

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts), dtype="f8")

    return df.withColumn(name, F.pandas_udf(run, "double")(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels may not be used for fitting."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def drop_toxic(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` scored below the threshold, with the columns of ``df``."""
    model = fit(training_rows(df, labels, ~held_out()))
    scored = score(boxed(df, F.col("text").alias("text")), model)
    return unboxed(scored.where(F.col("score") < threshold))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts get the model's score without n-grams;
    a null id is not held out; rows that repeat another have its score; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels"), ~held_out()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
