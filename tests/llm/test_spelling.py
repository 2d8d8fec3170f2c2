"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pdmspark.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def vocabulary(kind):
    rng = random.Random(kind)
    letters = {"few": "ab", "more": "abcdeé", "one": "a"}[kind]
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(250)}
    words |= {"a" * k for k in (6, 7, 8, 20, 5000)} | {"a" * 4000 + "b" + "a" * 1000}
    for w in sorted(words)[:80]:  # neighbours on purpose
        k = rng.randrange(len(w) + 1)
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]}
    return {w: rng.choice([5, 6, 25, 30, 150, 4000]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("kind", ["few", "more", "one"])
def test_forms_against_brute_force(spark, kind):
    words = vocabulary(kind)
    near = {a: [b for b in words if b != a and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 5 * words[a] else None
    want = []
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        want.append((a, form[a], root, words[a], len(near[a]), form[a] and words[form[a]]))
    got = spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
    assert kind == "one" or any(r[1] != r[2] for r in want if r[1])


def test_pivots_are_the_lightest_pair_apart():
    rng = random.Random(5)
    for _ in range(500):
        places = sorted(rng.sample(range(30), rng.randrange(3, 8)))
        places = [(p, rng.randrange(9)) for p in places]
        a, b = spelling.pivots_of(places)
        w = dict(places)
        assert b - a >= 2 and w[a] + w[b] == min(x + y for p, x in places for q, y in places if q - p >= 2)


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    texts = [(k, "Straße THEATRE théâtre ÉCOLEcole ab-abcdef abcdef×ghij " * (k % 3) + "x" * (5 + k % 4)) for k in range(400)]
    rows = [*texts, (7, None), (None, "nowhere nowhere"), (3, ""), *texts[:9]]
    want = Counter()
    for i, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 6:
                want[word] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).repartition(5)
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert len({*want} - {re.sub(r"\W", "", w) for w in ("straße", "theatre", "théâtre", "École")}) > 3
