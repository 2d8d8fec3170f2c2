"""Language-model scoring by logistic context mixing.

A text is its lower-cased words, each followed by one blank, and one more blank for its end; the model gives each bit of
these bytes a probability. Bits are predicted by counters in hashed contexts (the last 1 to 5 bytes of the word, and all
of it so far), whose logits are added up by weights that a gate selects, and a last stage corrects what the sum has been
wrong about. Within a document, what followed the last two words before is predicted first, by a yes or no that
is mixed from three adaptive counters by weights that learn bit after bit.

What a word costs depends on no other word until the yes or no, so it is computed once for each different word:

1. Texts are dealt to chunks of bounded size. A chunk's lexicon has its different words, with how often its training
   texts have them; added up over all chunks these are the counts of the corpus, and its different words.
2. Counters: each context table is filled from all training words, weighted by their counts. Tables grow with the number
   of different words up to ``MAX_BITS`` and are added up over tasks; a copy of all goes to the tasks, at most 50 MB.
3. Weights: every task runs over its training words block by block, predicts each word as if it had been seen once less,
   and corrects weights after each block. The weights and corrections of all tasks are averaged.
4. Every different word is scored, and the scores come back to the chunks, each of which is one bounded task.

Contexts across words and texts: the last ``CONTEXT`` words, at places that their hash chooses, predict the run of words up
to the next such place. What training texts have most often after the same words, the text itself left out, is the guess;
a yes or no about the whole run is mixed from counters, and a run that was guessed costs nothing more. A run ends where
its own words say, so no run begins another, and the probabilities of all texts add up to one at most.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_folder, table

#: A chunk has about this many bytes of text, and one text at least.
CHUNK_BYTES = 16_000_000
#: Bytes of context, 0 for all of the word so far.
ORDERS = (1, 2, 3, 4, 5, 0)
#: A table has so many slots (as a power of two), by the number of different training words.
MIN_BITS, MAX_BITS = 14, 22
#: Slots that travel together, and about how many different words fill a table in one task.
SEGMENT, SPLIT_WORDS = 1 << 12, 4_000_000
#: Different words of one task that learns weights, and of one step.
TASK_WORDS, STEP_WORDS = 400_000, 1024
#: Words are scored so many bytes at a time.
BLOCK_BYTES = 1 << 14
#: Texts of a chunk are scored so many tokens at a time, and one text at least.
PART_TOKENS = 400_000
#: Scores of words that a task holds before it packs them by chunk.
HELD_PLACES = 1 << 18
#: Size of the first corrections of a weight.
RATE = 0.02
#: A word weighs by this power of its count where weights are learnt, so that no word is all there is to a block.
WEIGH = 1.0
#: What a counter adds to both of its counts.
PRIOR = 0.1
#: Logits are corrected between so many supports from -LIMIT to LIMIT.
SUPPORTS, LIMIT = 33, 12.0
#: Counts that a byte can stand for: up to 64 exactly, then each some 11.6 % above the last, to 64 * 1.116 ** 191.
LEVELS = np.concatenate([np.arange(65.0), 64.0 * 1.116 ** np.arange(1, 192)])
#: Words of context that predict a run, and the bits of their hash that are 0 where one begins (one place in 16).
CONTEXT, PLACE_BITS = 3, 4
#: Guesses are told apart by the texts that have them (from 1, 2, 4, 8, 16, 32 on) and by their share of the texts with the context.
SUPPORT, SHARES = (2, 4, 8, 16, 32), 4
TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The gate: how often the word so far was seen (never, once, 2-3, 4-7 and so on), and the bit of the byte.
EVIDENCE = 12
GATES = 8 * EVIDENCE


def tokens_of(text: bytes) -> list[bytes]:
    """Words in lower case; bytes.split cuts at 0x20 and 0x09 to 0x0D."""
    return text.translate(TO_LOWER).split()


# --- bits of words -------------------------------------------------------------------------------------------------


class Bits:
    """The bits of some words (each with its blank), in order: ``bit``, ``word`` (its number), ``node``, and slots by table."""

    def __init__(self, words: pa.Array, bits: int, orders=range(len(ORDERS))):
        lengths = np.diff(np.frombuffer(words.buffers()[1], "i4", len(words) + 1, words.offset * 4)).astype("i8")
        first = np.frombuffer(words.buffers()[1], "i4", 1, words.offset * 4)[0]
        data = np.frombuffer(words.buffers()[2] or b"", "u1")[first : first + lengths.sum()]
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        n = int(ends[-1]) if len(ends) else 0
        text = np.full(n, 32, "u1")
        inner = np.ones(n, bool)
        inner[ends - 1] = False
        text[inner] = data
        self.lengths, self.ends = lengths, ends
        self.word = np.repeat(np.arange(len(words)), lengths + 1)
        place = np.arange(n) - starts[self.word]
        value = text.astype("u8") + np.uint64(1)
        high, low = text >> 4, text & 15
        # In each half byte the nodes are 1, then 2 and 3, and so on: the bits before, after a leading 1.
        self.bit = ((text[:, None] >> np.arange(7, -1, -1, dtype="u1")) & 1).astype("u1").ravel()
        node = np.empty((n, 8), "i4")
        for k in range(4):
            node[:, k] = (1 << k) | (high >> (4 - k))
            node[:, 4 + k] = (1 << k) | (low >> (4 - k))
        whole = (1 << np.arange(8, dtype="i4")) | (text[:, None].astype("i4") >> np.arange(8, 0, -1, dtype="i4")).astype("i4")
        self.node = whole.ravel()
        # Hash of all of the word so far: sums of value * POWER ** place, shifted back to the word's start.
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, *ORDERS), POWER, "u8")]))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE, "u8")]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:n])])
            so_far = (sums[:n] - sums[starts[self.word]]) * back[starts[self.word]]
            self.slots = []
            for k in orders:
                context = so_far
                if ORDERS[k]:
                    context = np.zeros(n, "u8")
                    for j in range(1, ORDERS[k] + 1):
                        has = place >= j
                        context[has] += value[np.flatnonzero(has) - j] * (power[j] + np.uint64(j))
                context = (context + np.uint64(k + 1)) * SPREAD
                context ^= context >> np.uint64(29)
                base = np.empty((n, 2), "u8")
                base[:, 0] = context * SPREAD
                base[:, 1] = (context + high.astype("u8") + np.uint64(1)) * SPREAD
                base = ((base >> np.uint64(64 - bits + 4)) << np.uint64(4)).astype("i4")
                slots = np.repeat(base, 4, axis=1)
                slots += node
                self.slots.append(slots.ravel())

    def per_word(self, of_bits: np.ndarray) -> np.ndarray:
        """Sums by word."""
        total = np.concatenate([[0.0], np.cumsum(of_bits)])
        return total[8 * self.ends] - total[8 * (self.ends - self.lengths - 1)]


#: Odd numbers for hashing, and the inverse of the first modulo 2 ** 64.
POWER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))


def blocks_of(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of words of bounded size: (first, words)."""
    ends = np.frombuffer(words.buffers()[1], "i4", len(words) + 1, words.offset * 4).astype("i8") + np.arange(len(words) + 1)
    k = 0
    while k < len(words):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + BLOCK_BYTES, "right")) - 1)
        yield k, words.slice(k, to - k)
        k = to


# --- the model -----------------------------------------------------------------------------------------------------


def _logits() -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of stored counts (no << 8 | yes) the logit and the evidence: with bit 0 seen once less, with bit 1, as it is."""
    no, yes = (x.ravel() for x in np.meshgrid(LEVELS, LEVELS, indexing="ij"))
    pairs = [(np.maximum(no - 1, 0), yes), (no, np.maximum(yes - 1, 0)), (no, yes)]
    logits = [np.log((b + PRIOR) / (a + PRIOR)) for a, b in pairs]
    evidence = [np.minimum(np.log2(np.maximum(a + b, 0.5)) + 1, EVIDENCE - 1) for a, b in pairs]
    return np.concatenate(logits).astype("f4"), np.concatenate(evidence).astype("i2")


class Model:
    """Context tables of stored counts, weights by gate, and corrections by node and support."""

    def __init__(self, bits: int, tables: np.ndarray):
        self.bits, self.tables = bits, tables
        self.weights = np.full((GATES, len(ORDERS)), 1.0 / len(ORDERS))
        self.shift = np.zeros((256, SUPPORTS))

    def inputs(self, bits: Bits, less: bool) -> tuple[np.ndarray, np.ndarray]:
        """(logits by table, gate) of each bit; with ``less`` as if its word had been seen once less."""
        logits, evidence = LOGITS
        x = np.empty((len(ORDERS), len(bits.bit)), "f4")
        at = bits.bit.astype("i4") << 16 if less else np.int32(2 << 16)
        for k, slots in enumerate(bits.slots):
            code = self.tables[k].take(slots).astype("i4") + at
            x[k] = logits.take(code)
        # The last table is that of the word so far.
        gate = evidence.take(code).reshape(-1, 8) * np.int16(8) + np.arange(8, dtype="i2")
        return x, gate.ravel()

    def logit(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype("f4")
        out = weights[0].take(gate) * x[0]
        for k in range(1, len(ORDERS)):
            out += weights[k].take(gate) * x[k]
        return out.clip(-LIMIT, LIMIT)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        at = (z + np.float32(LIMIT)) * np.float32((SUPPORTS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype("i4"), SUPPORTS - 2)
        part = at - low
        here = node * SUPPORTS + low
        shift = self.shift.ravel().astype("f4")
        return z + shift.take(here) * (1 - part) + shift.take(here + 1) * part

    def word_logs(self, words: pa.Array) -> np.ndarray:
        """log10 of each word's probability, its blank included."""
        out = np.empty(len(words))
        for k, some in blocks_of(words):
            bits = Bits(some, self.bits)
            z = self.refined(self.logit(*self.inputs(bits, False)), bits.node)
            out[k : k + len(some)] = bits.per_word(-np.log1p(np.exp(np.where(bits.bit == 1, -z, z)))) / math.log(10)
        return out


LOGITS = _logits()


def _filler(bits: int, order: int):
    """(word, n) rows to the counts of one table, by segment."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits))
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype("f8")
            for first, some in blocks_of(batch.column(0)):
                of = Bits(some, bits, [order])
                np.add.at(counts.ravel(), of.slots[0].astype("i8") + (of.bit.astype("i8") << bits), np.repeat(n[first + of.word], 8))
        parts = counts.reshape(2, -1, min(SEGMENT, 1 << bits))
        for s in np.flatnonzero(parts.any((0, 2))).tolist():
            columns = [pa.array([order], pa.int32()), pa.array([s], pa.int32()), pa.array([pa.compress(parts[:, s].tobytes(), "zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["order", "segment", "counts"])

    return fill


def _added(group: pa.Table, bits: int) -> pa.Table:
    """The counts of one segment of a table, added up and stored as two bytes a slot."""
    size = 16 * min(SEGMENT, 1 << bits)
    total = sum(np.frombuffer(pa.decompress(x.as_py(), size, "zstd", asbytes=True)) for x in group.column("counts"))
    no, yes = np.searchsorted(LEVELS, total.reshape(2, -1) * (1 - 1e-9)).clip(0, 255)
    codes = (no << 8 | yes).astype("u2").tobytes()
    return pa.table({"order": group.column("order").slice(0, 1), "segment": group.column("segment").slice(0, 1), "codes": pa.array([codes], pa.binary())})


def _learner(shared):
    """(word, n) of training words to sums for weights and corrections: (what, value, mass)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        model = Model(start.bits, start.tables)
        power, mean, mass = np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros(GATES)
        wrong = np.zeros((2, 256 * SUPPORTS))  # expected and seen ones at each support, beside their number
        seen = np.zeros(256 * SUPPORTS)
        step = 0
        for batch in batches:
            words, ns = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype("f8")
            for first in range(0, len(words), STEP_WORDS):
                for k, some in blocks_of(words.slice(first, STEP_WORDS)):
                    of = Bits(some, model.bits)
                    weight = np.repeat(ns[first + k + of.word] ** WEIGH, 8)
                    x, gate = model.inputs(of, True)
                    z = model.logit(x, gate)
                    p = 1 / (1 + np.exp(-z.astype("f8")))
                    err = weight * (of.bit - p)
                    held = np.bincount(gate, weight, GATES)
                    g = np.stack([np.bincount(gate, err * x[j], GATES) for j in range(len(ORDERS))], 1) / np.maximum(held, 1e-9)[:, None]
                    step += 1
                    power += 0.05 * (g * g - power)
                    model.weights += RATE / (1 + step / 100) * g / (np.sqrt(power / (1 - 0.95**step)) + 1e-4)
                    mean += held[:, None] * model.weights
                    mass += held
                    support = np.rint((z + LIMIT) * ((SUPPORTS - 1) / (2 * LIMIT))).astype("i8")
                    at = of.node * SUPPORTS + support
                    wrong[0] += np.bincount(at, weight * p, len(seen))
                    wrong[1] += np.bincount(at, weight * of.bit, len(seen))
                    seen += np.bincount(at, weight, len(seen))
        value = np.concatenate([mean.ravel(), wrong.ravel()])
        beside = np.concatenate([np.repeat(mass, len(ORDERS)), seen, seen])
        some = np.flatnonzero(beside)
        columns = [pa.array(some, pa.int32()), pa.array(value[some], pa.float64()), pa.array(beside[some], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["what", "value", "mass"])

    return learn


def fit(words: DataFrame) -> Model:
    """The model of the training words (word binary, n long) of a stored table; words with n = 0 are left alone."""
    trained = words.where("n > 0")
    n = trained.count()
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(16 * n + 1))))
    # One task for each table and run of words, without moving these; Spark would put tables of one run each into one task.
    some = trained.select("word", "n").coalesce(max(2, math.ceil(n / SPLIT_WORDS)))
    filled = reduce(DataFrame.unionByName, [some.mapInArrow(_filler(bits, k), "order int, segment int, counts binary") for k in range(len(ORDERS))])
    stored = filled.groupBy("order", "segment").applyInArrow(lambda group: _added(group, bits), "order int, segment int, codes binary")
    tables = np.zeros((len(ORDERS), 1 << bits), "u2")
    for r in stored.collect():  # at most two bytes for each slot
        codes = np.frombuffer(r["codes"], "u2")
        tables[r["order"], r["segment"] * len(codes) :][: len(codes)] = codes
    model = Model(bits, tables)
    shared = words.sparkSession.sparkContext.broadcast(model)
    tasks = max(1, math.ceil(n / TASK_WORDS))
    learnt = trained.coalesce(tasks).sortWithinPartitions(F.xxhash64("word")).mapInArrow(_learner(shared), "what int, value double, mass double")
    value, mass = np.zeros(model.weights.size + 2 * model.shift.size), np.zeros(model.weights.size + 2 * model.shift.size)
    for r in learnt.groupBy("what").agg(F.sum("value").alias("value"), F.sum("mass").alias("mass")).collect():  # one row for each number of the model
        value[r["what"]], mass[r["what"]] = r["value"], r["mass"]
    shared.unpersist()
    w = model.weights.size
    has = mass[:w] > 0
    model.weights.ravel()[has] = np.round(value[:w][has] / mass[:w][has], 6)
    expected, ones = value[w:].reshape(2, -1)
    seen = mass[w:].reshape(2, -1)[0]
    logit = lambda yes: np.log((yes + 1) / (seen - yes + 1))
    model.shift = np.round(np.where(seen > 0, logit(ones) - logit(expected), 0), 6).reshape(256, SUPPORTS)
    return model


# --- documents -----------------------------------------------------------------------------------------------------


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    """The rows of a chunk, compressed, as Arrow writes them."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        for r in rows:
            f.write_batch(r)
    return out.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _dealer(size: int):
    """(id, trained, text) rows to (chunk, texts): texts in a row of a task, up to a number of bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, bytes_held = TaskContext.get().partitionId() << 32, [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["chunk", "texts"])

        for batch in batches:
            ends = np.frombuffer(batch.column(2).buffers()[1], "i4", len(batch) + 1, batch.column(2).offset * 4) if len(batch) else np.zeros(1, "i4")
            first = 0
            while first < len(batch):
                room = max(0, size - bytes_held)
                to = int(np.searchsorted(ends, int(ends[first]) + room, "right")) - 1
                if to <= first and held:
                    yield emit()
                    chunk, held, bytes_held = chunk + 1, [], 0
                    continue
                to = max(to, first + 1)
                held.append(batch.slice(first, to - first))
                bytes_held += int(ends[to] - ends[first])
                first = to
        if held:
            yield emit()

    return deal


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word."""
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), "u1").astype("u8") + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, POWER, "u8"))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(data * power[place])])
    return _mixed(sums[ends] - sums[ends - lengths] + lengths.astype("u8"))


def _runs(ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, end, doc, key, digest) of the runs of some texts: words from first to end, after the words that key stands for.

    A text's first run begins after its first ``CONTEXT`` words, the others where the hash of the words before says so.
    """
    begins = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - begins[doc]
    h = hashes[ids]
    key = np.zeros(len(ids), "u8")
    power = np.cumprod(np.full(len(ids) + CONTEXT + 1, POWER, "u8"))
    for j in range(1, CONTEXT + 1):
        key[j:] += h[: max(0, len(ids) - j)] * power[j]
    key = _mixed(key)
    first = np.flatnonzero((place == CONTEXT) | ((place > CONTEXT) & (key >> np.uint64(64 - PLACE_BITS) == 0)))
    doc = doc[first]
    end = np.minimum(np.append(first[1:], len(ids)), (begins + lengths)[doc])
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(h * power[: len(ids)])])
    back = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(len(ids), INVERSE, "u8")]))
    digest = _mixed((sums[end] - sums[first]) * back[first] + (end - first).astype("u8"))
    return first, end, doc, key[first].view("i8"), digest.view("i8")


LEXICON = "chunk long, no int, word binary, n long, key long, digest long, docs int"


def _lexicon(across: bool):
    """Chunks to their different words in order of first place, with the number of each in training texts; with ``across``
    also to their different runs (no = -1), with the number of training texts (n) and of all texts (docs) that have them.

    The empty word is the end of a text.
    """

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = _unpacked(blob.as_py())
                trained = texts.column("trained").to_numpy(zero_copy_only=False).astype(bool)
                counts, runs, hashes = np.zeros(0, "i8"), [], np.zeros(0, "u8")
                for number, first, ids, lengths, _ in _parts(texts):
                    learnt = ids[np.repeat(trained[first : first + len(lengths)], lengths)]
                    now = np.bincount(learnt, minlength=len(number))
                    now[: len(counts)] += counts
                    counts = now
                    if across:
                        hashes = np.concatenate([hashes, _word_hashes(list(islice(number, len(hashes), None)))])
                        _, _, doc, key, digest = _runs(ids, lengths, hashes)
                        one = np.unique(np.stack([key, digest, doc], 1), axis=0) if len(doc) else np.zeros((0, 3), "i8")
                        runs.append(np.stack([one[:, 0], one[:, 1], trained[first + one[:, 2]], np.ones(len(one), "i8")], 1))
                k = len(counts)
                none = lambda kind, n: pa.nulls(n, kind)
                columns = [pa.array(np.full(k, chunk)), pa.array(np.arange(k, dtype="i4")), pa.array(number.keys(), pa.binary()), pa.array(counts), none(pa.int64(), k), none(pa.int64(), k), none(pa.int32(), k)]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
                if runs and len(all_runs := np.concatenate(runs)):
                    order = np.lexsort((all_runs[:, 1], all_runs[:, 0]))
                    x = all_runs[order]
                    new = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)]))
                    total, k = np.add.reduceat(x[:, 2:], new), len(new)
                    columns = [pa.array(np.full(k, chunk)), pa.array(np.full(k, -1, "i4")), none(pa.binary(), k), pa.array(total[:, 0]), pa.array(x[new, 0]), pa.array(x[new, 1]), pa.array(total[:, 1].astype("i4"))]
                    yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return lexicon


GUESS = ["key", "d1", "t1", "d2", "t2", "total"]
NAMES = [x.split()[0] for x in LEXICON.split(", ")]


def _parts(texts: pa.Table) -> Iterator[tuple[dict[bytes, int], int, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a chunk in runs of about ``PART_TOKENS`` tokens, one part at least: (number of each word so far, first text, ids, tokens and bytes of each text)."""
    number: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
    number_of = number.__getitem__
    ids, lengths, sizes, first, size = [], [], [], 0, 0
    of = lambda: (number, first, np.concatenate([np.zeros(0, "i8"), *ids]), np.array(lengths, "i8"), np.array(sizes, "i8"))
    for k, text in enumerate(texts.column("text")):
        words = tokens_of(text.as_py())
        words.append(b"")
        ids.append(np.fromiter(map(number_of, words), "i8", len(words)))
        size += len(words)
        lengths.append(len(words))
        sizes.append(sum(map(len, words)) + len(words))
        if size >= PART_TOKENS:
            yield of()
            ids, lengths, sizes, first, size = [], [], [], k + 1, 0
    if lengths or not first:
        yield of()


def _kinds(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The number of a guess's kind: by its texts (support) and its share of all of them."""
    return sum(((best >= x) * 1 for x in SUPPORT), 0) * SHARES + np.minimum(SHARES * best // total, SHARES - 1)


def _guesses(stored: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """What training texts have after contexts that two texts share, for each chunk with such: (chunk, key, digests and
    texts of the two most frequent runs, and all texts), and how often a guess of each kind is right in training texts."""
    spark = stored.sparkSession
    by = Window.partitionBy("key")
    # All windows lie within a key, so runs are shuffled once.
    runs = stored.where("no = -1").select("key", "digest", "chunk", "n", "docs").withColumn("_all", F.sum("docs").over(by)).where("_all > 1")
    runs = runs.withColumn("t", F.sum("n").over(Window.partitionBy("key", "digest"))).withColumn("total", F.sum("n").over(by)).where("total > 0")
    runs = runs.withColumn("r", F.dense_rank().over(by.orderBy(F.desc("t"), "digest")))
    of = lambda c, r: F.coalesce(F.max(F.when(F.col("r") == r, F.col(c))).over(by), F.lit(0))
    runs = runs.withColumns({"d1": of("digest", 1), "t1": of("t", 1), "d2": of("digest", 2), "t2": of("t", 2)})
    runs = runs.withColumn("sent", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("digest")) == 1)
    folder = fresh_folder(spark, "lm-runs")
    runs.select("key", "digest", "chunk", "n", "d1", "t1", "d2", "t2", "total", "sent").write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)
    # Each training text as if it were not among them.
    left = F.col("t1") - (F.col("digest") == F.col("d1")).cast("long")
    second = F.col("t2") > left
    hit = F.when(second, (F.col("digest") == F.col("d2")) & (F.col("t2") > 1)).otherwise(F.col("digest") == F.col("d1"))
    x = found.where("n > 0 and total > 1").select("n", hit.alias("hit"), F.when(second, F.col("t2")).otherwise(left).alias("best"), (F.col("total") - 1).alias("rest")).where("best > 0")
    support = sum(((F.col("best") >= k).cast("int") for k in SUPPORT), F.lit(0))
    kind = support * SHARES + F.least(F.expr(f"{SHARES} * best div rest"), F.lit(SHARES - 1))
    yes, no = (np.zeros((len(SUPPORT) + 1) * SHARES) for _ in range(2))
    for r in x.groupBy(kind.cast("int").alias("kind"), "hit").agg(F.sum("n").alias("n")).collect():  # two rows a kind
        (yes if r["hit"] else no)[r["kind"]] = r["n"]
    return found.where("sent").select("chunk", *GUESS), np.round((yes + 0.5) / (yes + no + 1), 6).clip(0.0005, 0.9995)


def _moved(q: float, hit: bool, rate: float) -> float:
    q += (hit - q) * rate
    return 0.0005 if q < 0.0005 else 0.9995 if q > 0.9995 else q


class Follower:
    """Whether a text goes on as training texts do after the same words: online mixing of three counters."""

    def __init__(self, right: list[float]):
        self.right = right
        self.by_past = [0.1, 0.4, 0.4, 0.7, 0.4, 0.7, 0.7, 0.98]
        self.by_kind: dict[int, float] = {}
        self.weights = [0.5, 0.4, 0.3]
        self.past = 0

    def cost(self, kind: int, hit: bool) -> float:
        """Log of the probability of what came about; everything but what training texts say adapts to it."""
        past, w = self.past, self.weights
        ps = (self.right[kind], self.by_past[past], self.by_kind.get(kind, self.right[kind]))
        x = [math.log(p / (1 - p)) for p in ps]
        z = max(-LIMIT, min(LIMIT, w[0] * x[0] + w[1] * x[1] + w[2] * x[2]))
        p = 1 / (1 + math.exp(-z))
        err = (hit - p) * 0.03
        for k in range(3):
            w[k] += err * x[k]
        self.by_past[past], self.by_kind[kind] = _moved(ps[1], hit, 0.05), _moved(ps[2], hit, 0.2)
        self.past = (past << 1 | hit) & 7
        return math.log(p if hit else 1 - p)


def _followed(ids: np.ndarray, lengths: np.ndarray, trained: np.ndarray, hashes: np.ndarray, table: np.ndarray, right: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(log of the runs' yes or no by text, which tokens were guessed); ``table`` has the chunk's guesses in order of key."""
    more, guessed = np.zeros(len(lengths)), np.zeros(len(ids), bool)
    first, end, doc, key, digest = _runs(ids, lengths, hashes)
    if not len(table) or not len(first):
        return more, guessed
    at = np.searchsorted(table[:, 0], key).clip(max=len(table) - 1)
    has = np.flatnonzero(table[at, 0] == key)
    if not len(has):
        return more, guessed
    first, end, doc, key, digest = (x[has] for x in (first, end, doc, key, digest))
    _, d1, t1, d2, t2, total = table[at[has]].T
    # The text's own runs do not count, wherever in it they are.
    _, pair = np.unique(np.stack([doc, key], 1), axis=0, return_inverse=True)
    pair = pair.ravel()
    own = lambda d: np.bincount(pair, digest == d, pair.max() + 1)[pair] > 0
    learnt = trained[doc]
    t1, t2 = t1 - (learnt & own(d1)), t2 - (learnt & own(d2) & (t2 > 0))
    mine = np.unique(np.stack([pair, digest], 1), axis=0)[:, 0]
    total = total - learnt * np.bincount(mine, minlength=pair.max() + 1)[pair]
    second = t2 > t1
    best, hit = np.where(second, t2, t1), np.where(second, d2, d1) == digest
    ask = np.flatnonzero(best > 0)
    kind = _kinds(best[ask], np.maximum(total[ask], best[ask]))
    last = -1
    for d, k, yes in zip(doc[ask].tolist(), kind.tolist(), hit[ask].tolist(), strict=True):
        if d != last:
            last, follower = d, Follower(right)
        more[d] += follower.cost(k, yes)
    edge = np.zeros(len(ids) + 1, "i4")
    right_ones = ask[hit[ask]]
    np.add.at(edge, first[right_ones], 1)
    np.add.at(edge, end[right_ones], -1)
    return more, np.cumsum(edge[:-1]) > 0


class Copier:
    """Whether a document's next word is the one that followed the last two words before: online mixing of three counters."""

    def __init__(self):
        self.by_length = [(k + 0.5) / (k + 2) for k in range(16)]
        self.by_past = [0.05, 0.2, 0.2, 0.4, 0.3, 0.5, 0.6, 0.95]
        self.by_word: dict[int, float] = {}
        self.weights = [[0.5, 0.4, 0.3] for _ in range(4)]
        self.length = self.past = 0

    def cost(self, word: int, hit: bool) -> float:
        """Log of the probability of what came about; everything adapts to it."""
        length, past, log = self.length if self.length < 15 else 15, self.past, math.log
        a, b, c = self.by_length[length], self.by_past[past], self.by_word.get(word, 0.3)
        x, y, v = log(a / (1 - a)), log(b / (1 - b)), log(c / (1 - c))
        w = self.weights[length if length < 3 else 3]
        z = w[0] * x + w[1] * y + w[2] * v
        z = -LIMIT if z < -LIMIT else LIMIT if z > LIMIT else z
        p = 1 / (1 + math.exp(-z))
        err = (hit - p) * 0.03
        w[0] += err * x
        w[1] += err * y
        w[2] += err * v
        self.by_length[length], self.by_past[past], self.by_word[word] = _moved(a, hit, 0.05), _moved(b, hit, 0.05), _moved(c, hit, 0.3)
        self.past = (past << 1 | hit) & 7
        self.length = self.length + 1 if hit else 0
        return log(p if hit else 1 - p)


SCORED = "id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scored(texts: pa.Table, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, counts: np.ndarray, logs: np.ndarray, total: int, different: int, more: np.ndarray, guessed: np.ndarray) -> pa.Table:
    """A row for each text; ``ids`` are the places of their words in the lexicon, ``lengths`` how many each text has.

    Tokens that were ``guessed`` are paid for by ``more``."""
    base = np.log10((counts + 1) / (total + different + 1))
    begins = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda x: np.add.reduceat(x, begins) if len(x) else np.zeros(0)

    # The place where the last two words stood together before, if they did.
    two = np.flatnonzero(np.arange(len(ids)) - begins[doc] >= 2)
    key = (doc[two] * len(counts) + ids[two - 2]) * len(counts) + ids[two - 1]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    now, then = two[order[again + 1]], two[order[again]]
    sort = np.argsort(now)
    now, guess = now[sort], ids[then[sort]]
    asked = ~guessed[now]
    now, guess = now[asked], guess[asked]
    hit = guess == ids[now]
    logs_of = logs[ids]
    # A word that was not the guess is none of the guess: its probability is that among the others.
    p = np.minimum(10.0 ** logs[guess[~hit]], 1 - 1e-9)
    logs_of[now[~hit]] -= np.log1p(-p) / math.log(10)
    logs_of[now[hit]] = 0.0
    logs_of[guessed] = 0.0
    at = -1
    for d, word, right in zip(doc[now].tolist(), guess.tolist(), hit.tolist(), strict=True):
        if d != at:
            at, copier = d, Copier()
        more[d] += copier.cost(word, right)
    score = add(logs_of) + more / math.log(10)
    out = {
        "id": texts.column("id"), "held_out": pa.array(~texts.column("trained").to_numpy(zero_copy_only=False).astype(bool)), "n_tokens": lengths, "n_known": add((counts[ids] > 0).astype("i8")).astype("i8"),
        "train_tokens": np.full(len(lengths), total), "base_score": add(base[ids]), "score": score, "n_bytes": sizes, "bits_per_byte": -score * math.log2(10) / sizes,
    }
    return pa.table(out)


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries inside go when a query ends, and not when the driver happens to collect garbage."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(option)
        else:
            spark.conf.set(option, before)


def _squeezed(no: np.ndarray, n: np.ndarray, log: np.ndarray) -> bytes:
    """Numbers of words in ascending order, with counts and logs: 16 bytes a word, like bytes side by side, compressed."""
    columns = [np.diff(no, prepend=np.int32(0)).astype("i4"), n.astype("i8"), log.astype("f4")]
    return pa.compress(b"".join(x.view("u1").reshape(len(x), -1).T.tobytes() for x in columns), "zstd", asbytes=True)


def _opened(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 16 * size, "zstd", asbytes=True), "u1").reshape(16, size)
    no, n, log = (raw[a:b].T.copy().view(kind).ravel() for a, b, kind in ((0, 4, "i4"), (4, 12, "i8"), (12, 16, "f4")))
    return np.cumsum(no), n, log


def _by_chunk(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(chunk, no, n, log) arrays to one row for each chunk."""
    chunk, no, n, log = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((no, chunk))
    chunk, no, n, log = (x[order] for x in (chunk, no, n, log))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
    blobs = [_squeezed(no[a:b], n[a:b], log[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    columns = [pa.array(chunk[cuts[:-1]]), pa.array(np.diff(cuts), pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "size", "scores"])


def _scorer(total: int, different: int, right: list[float] | None):
    """The texts of a chunk, in one row, beside rows of its guesses (no texts), with its lexicon in packs: one row for each text."""

    def score(chunk: pa.Table, lexicon: pa.Table) -> pa.Table:
        texts = _unpacked(chunk.column("texts").drop_null()[0].as_py())
        trained = texts.column("trained").to_numpy(zero_copy_only=False).astype(bool)
        packs = [_opened(blob.as_py(), size) for size, blob in zip(lexicon.column("size").to_pylist(), lexicon.column("scores"), strict=True)]
        no, counts, logs = (np.concatenate(x) for x in zip(*packs, strict=True))
        order = np.argsort(no)
        counts, logs = counts[order].astype("f8"), logs[order].astype("f8")
        hashes, parts = np.zeros(0, "u8"), []
        if right is not None:
            table = np.stack([chunk.column(c).drop_null().to_numpy() for c in GUESS], 1)
            table = table[np.argsort(table[:, 0])]
        for number, first, ids, lengths, sizes in _parts(texts):
            more, guessed = np.zeros(len(lengths)), np.zeros(len(ids), bool)
            if right is not None and len(table):
                hashes = np.concatenate([hashes, _word_hashes(list(islice(number, len(hashes), None)))])
                more, guessed = _followed(ids, lengths, trained[first : first + len(lengths)], hashes, table, right)
            parts.append(_scored(texts.slice(first, len(lengths)), ids, lengths, sizes, counts, logs, total, different, more, guessed))
        return pa.concat_tables(parts)

    return score


def score_texts(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, across: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, held_out (not ``trained``), n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    base_score is that of a unigram model with one added to each count, score the model's log10 probability of the text, and
    bits_per_byte its bits over n_bytes, the bytes of the lower-cased words with a blank for each and for the end. A null
    text is empty: it has the end only. A null ``trained`` is false. Without training texts the model is the one it
    starts from. An empty table gives an empty result. Rows that repeat others are read, and learnt, again.

    With ``across``, contexts of words of all training texts take part; a training text is then predicted from the others.
    Without, words are predicted from their own bytes and from the same text alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    folder = fresh_folder(spark, "lm-texts")
    rows.mapInArrow(_dealer(chunk_bytes), "chunk long, texts binary").write.option("compression", "zstd").parquet(folder)
    texts = spark.read.parquet(folder)
    folder = fresh_folder(spark, "lm-lexicon")
    texts.mapInArrow(_lexicon(across), LEXICON).write.option("compression", "zstd").parquet(folder)
    lexicon = spark.read.parquet(folder)
    folder = fresh_folder(spark, "lm-words")
    right = None
    with _shuffles_dropped(spark):
        # A word has one place in a chunk: lists are as long as there are chunks, at most.
        lexicon.where("no >= 0").groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "no")).alias("places")).write.option("compression", "zstd").parquet(folder)
        stored = spark.read.parquet(folder)
        words = stored.select("word", "n")
        total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
        shared = spark.sparkContext.broadcast(fit(words))
        if across:
            guesses, right = _guesses(lexicon)
            right = right.tolist()
            texts = texts.unionByName(guesses, allowMissingColumns=True)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            times, places = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten()
            ns, ls = batch.column(1).to_numpy(), shared.value.word_logs(batch.column(0)).astype("f4")
            held.append((places.field(0).to_numpy(), places.field(1).to_numpy(), np.repeat(ns, times), np.repeat(ls, times)))
            size += len(places)
            if size >= HELD_PLACES:
                yield _by_chunk(held)
                held, size = [], 0
        if size:
            yield _by_chunk(held)

    known = stored.mapInArrow(logs, "chunk long, size int, scores binary")
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda a, b: _scorer(total, different, right)(a, b), SCORED.format(kind))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; those whose crc32(doc_id as text) mod 7 is not 2 are learnt from. A null id is an empty text there. See ``score_texts``."""
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    return score_texts(table(spark, sf_dir, "documents"), trained, across=True).withColumnRenamed("id", "doc_id")
