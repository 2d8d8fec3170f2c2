"""Language-model scores against scalar definitions."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pdmspark.llm import lm_scoring as lm

M64 = (1 << 64) - 1


def slow_bits(word):
    """(bit, node, contexts so far) of each bit of the word and its blank."""
    for place, byte in enumerate(data := word + b" "):
        for k in range(7, -1, -1):
            yield byte >> k & 1, (1 << (7 - k)) | (byte >> (k + 1)), data[:place], k


def slow_slot(k, bits, before, node, high):
    context = 0
    if lm.ORDERS[k]:
        for j in range(1, min(lm.ORDERS[k], len(before)) + 1):
            context += (before[-j] + 1) * (pow(int(lm.POWER), j, 1 << 64) + j)
    else:
        context = sum((b + 1) * pow(int(lm.POWER), j, 1 << 64) for j, b in enumerate(before))
    context = (context + k + 1) * int(lm.SPREAD) & M64
    context ^= context >> 29
    base = (context if high is None else context + high + 1) * int(lm.SPREAD) & M64
    inner = node if high is None else (1 << (node.bit_length() - 5)) | (node & ((1 << (node.bit_length() - 5)) - 1))
    return (base >> (64 - bits + 4) << 4) + inner


def slow_log(model, word):
    """log10 of the word's probability, bit by bit."""
    total = 0.0
    for bit, node, before, k in slow_bits(word):
        high = None if k >= 4 else node >> (node.bit_length() - 5) & 15
        x = []
        for o in range(len(lm.ORDERS)):
            code = int(model.tables[o][slow_slot(o, model.bits, before, node, high)])
            no, yes = lm.LEVELS[code >> 8], lm.LEVELS[code & 255]
            x.append(math.log((yes + lm.PRIOR) / (no + lm.PRIOR)))
        seen = no + yes
        gate = (min(int(math.log2(seen)) + 1, lm.EVIDENCE - 1) if seen else 0) * 8 + 7 - k
        z = max(-lm.LIMIT, min(lm.LIMIT, sum(w * a for w, a in zip(model.weights[gate], x, strict=True))))
        at = (z + lm.LIMIT) * (lm.SUPPORTS - 1) / (2 * lm.LIMIT)
        low = min(int(at), lm.SUPPORTS - 2)
        z += model.shift[node][low] * (1 - at + low) + model.shift[node][low + 1] * (at - low)
        total -= math.log1p(math.exp(-z if bit else z))
    return total / math.log(10)


def test_words_are_scored_bit_by_bit(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40)
    rng = np.random.default_rng(1)
    model = lm.Model(14, rng.integers(0, 1 << 16, (len(lm.ORDERS), 1 << 14)).astype("u2"))
    model.tables[:, ::3] = 0
    model.weights = rng.normal(0.2, 0.2, model.weights.shape)
    model.shift = rng.normal(0, 0.1, model.shift.shape)
    words = [b"", b"a", b"the", b"abcdefghij" * 9, "élève".encode(), b"\x00\xff", b"the"]
    got = model.word_logs(pa.array([b"cut", *words], pa.binary()).slice(1))
    assert np.allclose(got, [slow_log(model, w) for w in words], rtol=1e-5)


def test_bits_of_a_byte_add_up_to_one():
    rng = np.random.default_rng(2)
    model = lm.Model(14, rng.integers(0, 1 << 16, (len(lm.ORDERS), 1 << 14)).astype("u2"))
    first = [bytes([b]) for b in range(256)]
    whole = 10 ** np.array([slow_log(model, w) for w in first])
    bits = lm.Bits(pa.array(first, pa.binary()), 14)
    z = model.refined(model.logit(*model.inputs(bits, False)), bits.node).reshape(256, 16)[:, :8]
    p = np.exp(-np.logaddexp(0, np.where(bits.bit.reshape(256, 16)[:, :8] == 1, -z, z)).sum(1))
    assert abs(p.sum() - 1) < 1e-9 and (whole <= p).all()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "Engine", "bearing", "wear", "é", "vibration"]) for _ in range(n))


def rows_of():
    docs = [(k, prose(k % 90, k) + ("\n" + prose(12, 3)) * (k % 4)) for k in range(160)]
    return [*docs, (500, None), (501, ""), (None, " \t\n"), (502, "unseen wörd zzz zzz unseen wörd zzz zzz unseen wörd zzz"), (503, "q" * 70_000), (7, "twice"), (7, "twice")]


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_scores(spark, chunk, monkeypatch):
    models = []
    monkeypatch.setattr(lm, "PART_TOKENS", 150)
    monkeypatch.setattr(lm, "fit", lambda words, f=lm.fit: models.append(f(words)) or models[-1])
    rows = rows_of()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, score string").repartition(3)
    trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    got = lm.score_texts(df, trained, chunk_bytes=chunk).collect()
    counts = Counter()
    cut = lambda t: lm.tokens_of((t or "").encode()) + [b""]
    for i, t in rows:
        if not held(i):
            counts.update(cut(t))
    n, v = sum(counts.values()), len(counts)
    logs: dict = {}
    want = []
    for i, t in rows:
        tokens = cut(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        score, copier, seen = 0.0, lm.Copier(), {}
        number: dict = {}
        for k, w in enumerate(tokens):
            if w not in logs:
                logs[w] = float(models[0].word_logs(pa.array([w], pa.binary()))[0])
            guess = seen.get(tuple(tokens[k - 2 : k])) if k >= 2 else None
            if guess is not None:
                hit = guess == w
                score += copier.cost(number.setdefault(guess, len(number)), hit) / math.log(10)
                if not hit:
                    score += logs[w] - math.log10(1 - min(10 ** logs[guess], 1 - 1e-9))
            else:
                score += logs[w]
            if k >= 2:
                seen[tuple(tokens[k - 2 : k])] = w
        want.append((i, held(i), len(tokens), sum(w in counts for w in tokens), n, round(base, 6), round(score, 4)))
    mine = [(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in got]
    a, b = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[6])), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert all(abs(x[5] - y[5]) < 1e-5 and abs(x[6] - y[6]) < 1e-3 for x, y in zip(a, b, strict=True))
    assert all(r["bits_per_byte"] > 0 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = sorted(lm.score_texts(df, F.lit(False)).collect())
    assert [r["train_tokens"] for r in got] == [0, 0] and [r["n_known"] for r in got] == [0, 0] and all(r["base_score"] == 0 and r["score"] < 0 for r in got)


def test_learning_pays(spark):
    """Held-out prose costs far less than 8 bits a byte, and less than text of other words."""
    rows = [(k, prose(60, k)) for k in range(300)] + [(900, " ".join("xqzjwvkp" for _ in range(3)))]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 250).collect()
    bits = {r["id"]: r["bits_per_byte"] for r in got}
    assert max(bits[k] for k in range(250, 300)) < 1.0 < 3.0 < bits[900]


@pytest.mark.parametrize("chunk", [2_000, 1 << 20])
def test_contexts_across_texts(spark, chunk, monkeypatch):
    """A text that training texts have as well costs next to nothing, one that only they themselves have what it cost before."""
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    rng = random.Random(4)
    text = lambda n=120: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = {k: text() for k in range(60)}
    docs[2] = text(500)
    docs[100], docs[101], docs[102] = docs[0].upper(), docs[1], "\n".join([text(40), docs[2], text(40)])
    docs[103], docs[104], docs[105] = (x := text()), x, None
    docs[106], docs[109] = " ".join([text(1)] * 400), docs[3]
    rows = [*docs.items(), (107, "one two three four"), (108, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = [1, 100, 103, 104]  # 103 and 104 are copies that no training text has
    got = {}
    for across in (False, True):
        for r in lm.score_texts(df, ~F.col("doc_id").isin(held), chunk_bytes=chunk, across=across).collect():
            got[r["id"], across] = r
    assert len(got) == 2 * len(rows)
    gain = {k: got[k, True]["score"] - got[k, False]["score"] for k, _ in rows}
    assert all(abs(gain[k]) < 1e-6 for k in [0, 101, *range(4, 60), 103, 104, 105, 106])  # 0 and 101 are the only training texts of their kind
    for k in (1, 100, 3, 109):
        assert got[k, True]["score"] > 0.1 * got[k, False]["score"], k
    assert all(got[k, True]["score"] > 0.5 * got[k, False]["score"] for k in (2, 102))  # a long passage of theirs
    assert gain[107] > 0 and gain[108] > 0
    assert all(got[k, True][c] == got[k, False][c] for k, _ in rows for c in ("n_tokens", "n_known", "train_tokens"))


def test_runs_are_those_of_their_words():
    """Places and digests depend on words alone: not on the part, the numbers of the words or what stands before."""
    rng = random.Random(5)
    texts = [[b"%d" % rng.randrange(40) for _ in range(n)] + [b""] for n in (0, 1, 2, 3, 4, 90, 200)]
    texts += [texts[-1][50:], texts[-1]]

    def runs(some):
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for t in some for w in t], "i8")
        first, end, doc, key, digest = lm._runs(ids, np.array([len(t) for t in some], "i8"), lm._word_hashes(list(number)))
        flat = [w for t in some for w in t]
        return doc.tolist(), [(k, d, flat[f - 3 : f], flat[f:e]) for f, e, k, d in zip(first, end, key.tolist(), digest.tolist(), strict=True)]

    doc, together = runs(texts)
    assert together == [r for t in texts for r in runs([t])[1]]
    assert doc[0] == 3 and all(r[3] for r in together)
    for t, text in enumerate(texts):
        assert [w for d, r in zip(doc, together, strict=True) if d == t for w in r[3]] == text[3:]
    by_words = {(tuple(r[2]), tuple(r[3])): r[:2] for r in together}
    assert len(set(by_words.values())) == len(by_words) and all(by_words[tuple(r[2]), tuple(r[3])] == r[:2] for r in together)


def test_no_shuffle_files_are_left(spark):
    """What earlier steps shuffled is gone when the scores are about to be made, and the session's option is as it was."""
    files = lambda: set(re.findall(r"/(shuffle_\w+)", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.createDataFrame([(k, prose(60, k % 20)) for k in range(60)], "doc_id long, text string").repartition(3).localCheckpoint()
    before, option_before = files(), spark.conf.get(option, None)
    scores = lm.score_texts(df, F.col("doc_id") < 50, across=True)
    end = time.time() + 10
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(option, None) == option_before
    assert scores.count() == 60


def test_runs_are_shuffled_once(spark, tmp_path):
    """Guesses, and what they are right about, for runs of two keys; the rows that chunks get come from one shuffle."""
    rows = [(1, 10, 0, 2, 2), (1, 10, 1, 1, 1), (1, 11, 0, 3, 4), (1, 12, 1, 1, 1), (2, 20, 0, 1, 1), (3, 30, 0, 0, 1), (3, 31, 1, 0, 1), (4, 40, 1, 2, 2)]
    runs = spark.createDataFrame(rows, "key long, digest long, chunk long, n long, docs int").withColumn("no", F.lit(-1))
    runs.write.parquet(str(tmp_path / "runs"))
    sent, right = lm._guesses(spark.read.parquet(str(tmp_path / "runs")))
    want = [(0, 1, 10, 3, 11, 3, 7), (1, 1, 10, 3, 11, 3, 7), (1, 4, 40, 2, 0, 0, 2)]
    assert sorted(tuple(r) for r in sent.select("chunk", *lm.GUESS).collect()) == want and len(right) == (len(lm.SUPPORT) + 1) * lm.SHARES
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()


def test_packs_of_scores():
    """A chunk's words come back from its packs, whatever tasks held them and in whatever order."""
    rng = np.random.default_rng(6)
    chunk, no = np.repeat(np.array([7 << 32, (7 << 32) + 1, 0]), 500), np.tile(rng.integers(0, 2**31 - 1, 500).astype("i4"), 3)
    n, log = rng.integers(0, 1 << 40, 1500), rng.normal(size=1500).astype("f4")
    mix = rng.permutation(1500)
    rows = [x[mix] for x in (chunk, no, n, log)]
    batch = lm._by_chunk([tuple(x[:700] for x in rows), tuple(x[700:] for x in rows)])
    got = set()
    for c, size, blob in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
        got |= {(c, *r) for r in zip(*[x.tolist() for x in lm._opened(blob, size)], strict=True)}
    assert batch.num_rows == 3 and got == set(zip(*[x.tolist() for x in (chunk, no, n, log)], strict=True))
