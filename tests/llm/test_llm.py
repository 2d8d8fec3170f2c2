"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing names."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pdmspark.llm import common, decontamination, exact_dedup, mixing, registry, sharding, simhash, substring_dedup, suffix_dedup, tokens, toxicity, url_filter
from pdmspark.llm.components import connected_components

from ..conftest import SF

KIND = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
#: Queries without a row for each document.
OTHERS = {"op5_substring_dedup", "op11_spelling_variants", "op13_hard_negatives"}
#: Null in every column, blank and repeated texts, repeated rows, a repeated id, a null id.
ODD = [
    (5, "a  b\tc", "en", "s1", 6), (3, "a b c", "en", "s1", 5), (3, "a b c", "en", "s1", 5), (7, None, None, None, None), (8, "", "en", None, 0), (9, " \n ", "en", "s2", 3),
    (None, "x y z", "en", "s2", 5), (2, "x y z", None, "s2", 5), (2, "other words here", "en", "s3", 16), (11, "Ünï çødé, 漢字 😀 don't we've 12 3a", "fr", "s3", 30), (12, "q" * 300_000 + " end", "en", "s1", 300_004),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def save(df, folder, name="documents"):
    df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def odd_dir(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    save(odd, d)
    save(spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string"), d, "benchmark")
    save(spark.createDataFrame([(3, 1, 1), (None, 0, 1), *[(k, 1, 0) for k in (2, 5, 7, 8, 9, 11, 12)]], "doc_id long, quality int, toxic int"), d, "labels")
    save(spark.createDataFrame([(1, None, ""), (None, "http://porn.org", None)], "page_id long, url string, html string"), d, "pages")
    save(spark.createDataFrame([(k, [1.0, k / 9.0], k % 3) for k in range(0, 120, 5)] + [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 1), (4, [1.0, 1.0], None)], VECTORS), d, "embeddings")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    save(spark.createDataFrame([], KIND), d)
    save(spark.createDataFrame([], "item_id long, text string"), d, "benchmark")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), d, "labels")
    save(spark.createDataFrame([], "page_id long, url string, html string"), d, "pages")
    save(spark.createDataFrame([], VECTORS), d, "embeddings")
    return d


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows_give_one_row_each(spark, odd_dir, name):
    n = len(registry.queries()[name](spark, odd_dir).collect())
    assert name in OTHERS or n == (2 if name == "op6_url_filter" else len(ODD))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, odd_dir, name):
    for d, files in ((SF, "{}/{}.parquet"), (odd_dir, "{}/{}.parquet/*.parquet")):
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files.format(d, t)}')")
        df = registry.queries()[name](spark, d)
        r = c.execute(registry.oracle_sql()[name])
        at = [[x[0] for x in r.description].index(k) for k in df.columns]
        assert Counter(tuple(x) for x in df.collect()) == Counter(tuple(x[i] for i in at) for x in r.fetchall())


def clash(df, *names):
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def test_clashing_names_survive(spark, odd):
    x = clash(odd, "kept", "keep_id", "_row", "_h", "_b", "sha256", "id")
    assert exact_dedup.exact_dedup(x).columns == x.columns and exact_dedup.exact_dedup(x).where("kept <> 'own kept'").isEmpty()
    x = clash(odd, "shard", "_h", "_at", "_part")
    out = sharding.interleave(x, 3)
    assert sorted(out.columns) == sorted([*x.columns, "slot"]) and out.where("_h <> 'own _h'").isEmpty()
    x = clash(odd, "position", "_size", "repeats", "taken", "size", "target")
    assert mixing.mix(x).where("taken <> 'own taken'").isEmpty()
    x = clash(odd, "fp", "id", "component", "_key", "text_hash")
    assert simhash.simhash_dedup(x).columns == x.columns
    x = clash(odd, "matches", "n_words", "items", "contaminated")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.decontaminate(x, bench).columns == x.columns
    x = clash(odd, "score", "_toxicity")
    assert toxicity.drop_toxic(x, spark.createDataFrame([(3, 1)], "doc_id long, toxic int")).columns == x.columns
    x = clash(odd, "_spans", "_text", "_k1", "spans", "k1")
    assert suffix_dedup.suffix_dedup(x).columns == x.columns
    x = clash(odd, "_spans", "spans", "_id", "_key", "key", "id", "_row", "start")
    assert substring_dedup.substring_dedup(x).columns == x.columns and substring_dedup.substring_dedup(x).count() == len(ODD)
    x = clash(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), "host", "fit", "hits", "_row")
    assert url_filter.judge_urls(x).first()["host"] == "a.org" and url_filter.judge_urls(x).first()["fit"] == "own fit"


# 1 -------------------------------------------------------------------------------------------------------------------


def test_exact_dedup_heavy_and_light_groups(spark):
    data = [(k, "hot text" if k % 3 else f"text {k // 7}") for k in range(6000)] + [(1, "hot text")]
    x = spark.createDataFrame(data, "doc_id long, text string")
    d = x.select("doc_id", exact_dedup.normal_digest(F.col("text")).alias("text_sha256"))
    assert exact_dedup.heavy_winners(d, "doc_id", "text_sha256").count() >= 1
    got = exact_dedup.mark_duplicates(d).collect()
    size, least = Counter(t for _, t in data), {}
    for k, t in data:
        least[t] = min(k, least.get(t, k))
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert len(got) == len(data)
    assert all(r["group_size"] == size[sha[r["text_sha256"]]] and r["keep_id"] == least[sha[r["text_sha256"]]] for r in got)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(size) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(x).count() == len(size)


# 2 -------------------------------------------------------------------------------------------------------------------

HARD = ["a  b", "  lead", " trail ", "x\ty z", "don't we're it's", "<|endoftext|> a", "a\n\nb\n c", "é, ñ! ß. ×÷ 12 3a a3", "\0a b\0", "foo\x1c bar", "日本 語。 a b", "a, b.c d!", "'s 's", "", ".", "a b c", "x y\n", "w" * 200 + " e", "a\r\nb"]


def library_ids(texts):
    """Ids from a tokenizer loaded anew, with nothing set on it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    e = tokens.Encoder(tokens.default_tokenizer())
    random.seed(1)
    made = ["".join(random.choice("ab é,.!\n 1'") for _ in range(random.randint(0, 80))) for _ in range(300)]
    texts = HARD + made
    want = library_ids(texts)
    assert e.encode(texts) == want and e.encode(texts) == want


@pytest.mark.parametrize("remembered", [0, 3])
def test_encoder_that_remembers_little(remembered):
    e = tokens.Encoder(tokens.default_tokenizer(), remembered)
    want = library_ids(HARD)
    assert e.encode(HARD) == want and e.encode(HARD[::-1]) == want[::-1]
    assert len(e.known) == remembered


def test_each_text_alone_on_a_fresh_and_on_a_warm_encoder():
    warm = tokens.Encoder(tokens.default_tokenizer())
    warm.encode(["the end a b"])
    texts = [*HARD, *[t or "" for _, t, *_ in ODD], "\n", "\n\n", "the end\n\nthe end", "the end", "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b\n\n<|endoftext|> <|endoftext|>", "<|endoftext"]
    for t, want in zip(texts, library_ids(texts), strict=True):
        assert warm.encode([t]) == [want] and warm.encode([t, ""]) == [want, b""]
        fresh = tokens.Encoder.__new__(tokens.Encoder)
        fresh.__dict__ = warm.__dict__ | {"known": {}}
        assert fresh.encode([t]) == [want]


@pytest.mark.parametrize("rows", [[(1, "")], [(1, None)], [(1, "\n")], [(1, ""), (2, None), (3, "a\n\nb")]])
def test_token_files_of_texts_without_words(spark, tmp_path, rows):
    got = tokens.token_rows(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", tokens.default_tokenizer()).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(x) // 4 + 1 for x in library_ids([t or "" for _, t in rows])]


def test_encoder_where_gaps_make_up_for_each_other():
    e = tokens.Encoder(tokens.default_tokenizer())
    random.seed(11)
    texts = [t.replace("\t", b) for t in ("a\tb\tc\n\n", "a\n\n\nb\tc\td", "a\tb  c", " a\tb", "a\tb \n c\td") for b in "\t\xa0\u3000\x1c\x85"]
    texts += ["".join(random.choice("ab é,\n\n 1'\t\xa0") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    assert e.encode(texts) == library_ids(texts)


def test_token_file_round_trip_and_damage():
    random.seed(2)
    docs = [(None if k == 3 else k, np.array([random.randrange(60_000) for _ in range(random.choice([0, 1, 5, 3000]))], "<u4")) for k in range(50)]
    out = io.BytesIO()
    w = tokens.FileWriter(out, True, 4000)
    for k, ids in docs:
        w.add(k, ids.tobytes())
    w.close()
    f = tokens.TokenFile(out)
    assert len(f.packed) > 5 and f.nulls.tolist() == [k is None for k, _ in docs]
    for i, ids in f.read([2, 3, 17, 49]):
        assert ids.tolist() == docs[i][1].tolist()
    assert all(ids.tolist() == docs[i][1].tolist() for i, ids in f.read())
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(out.getvalue()[: int(f.places[-1])])
    assert np.frombuffer(raw, "<u2").tolist() == [x for _, ids in docs for x in ids.tolist()]
    broken = bytearray(out.getvalue())
    broken[int(f.places[1]) + 20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokens.TokenFile(io.BytesIO(bytes(broken))).read([int(np.searchsorted(f.starts * 2, f.begins[1]))]))


def test_token_files(spark, odd_dir):
    got = registry.queries()["op2_token_files"](spark, odd_dir).collect()
    docs = sorted(((-1 if k is None else k, x or "") for k, x, *_ in ODD), key=lambda d: (d[0], d[1]))
    start, want = 0, Counter()
    for k, x in docs:
        ids = library_ids([x])[0] + b"\0" * 4
        want[(None if k == -1 else k, start, len(ids) // 4, zlib.crc32(ids))] += 1
        start += len(ids) // 4
    assert Counter(tuple(r) for r in got) == want


def test_only_asked_documents_are_read(spark, tmp_path):
    x = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    files = tokens.write_tokens(x, f"file://{tmp_path}/t", tokens.default_tokenizer(), frame_ids=50)
    assert files.agg(F.sum("n_docs")).first()[0] == 300
    got = tokens.read_tokens(files, f"file://{tmp_path}/t", only=[7, 150, 999]).collect()
    want = dict(zip((7, 150), library_ids(["text number 7", "text number 150"]), strict=True))
    assert {r["doc_id"]: r["ids"] for r in got} == {k: [*np.frombuffer(x, "<u4").tolist(), 0] for k, x in want.items()}
    assert tokens.read_tokens(files, f"file://{tmp_path}/t", only=[]).collect() == []
    back = tokens.token_rows(x.withColumn("at", -F.col("doc_id")), f"file://{tmp_path}/u", tokens.default_tokenizer(), ["at"]).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == list(range(299, -1, -1))


# 3 -------------------------------------------------------------------------------------------------------------------


def test_mixture_meets_targets_and_curriculum(spark):
    random.seed(4)
    data = [(k, " ".join("w" * 1 for _ in range(random.randint(0, 40))), random.choice(["a", "a", "a", "a", "b", None])) for k in range(1500)]
    x = spark.createDataFrame(data, "doc_id long, text string, source string")
    w = mixing.weights_from({"a": [1, 0, 1], "b": [1, 3, 0], None: [2, 2, 2]})
    mixed = mixing.mix(x, w)
    assert mixed.columns == ["doc_id", "text", "source", "position"]
    got = mixed.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    sized = x.withColumn("size", mixing.word_count(F.col("text")))
    targets = {r["source"]: r for r in mixing.plan_targets(sized.select("source", "size"), w).collect()}
    words = Counter()
    for r in got:
        words[r["source"]] += len(r["text"].split())
    for s, t in targets.items():
        assert abs(words[s] - t["target"]) <= 40 and t["target"] <= 3 * t["source_size"] + 1e-9
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3
    middle = [r for r in got if r["source"] == "a" and 1 / 3 + 0.01 < r["position"] < 2 / 3 - 0.01]
    late_b = [r for r in got if r["source"] == "b" and r["position"] > 2 / 3 + 0.01]
    assert not middle and not late_b
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(x.repartition(7), w).collect()))


def test_default_curriculum(spark):
    assert [sum(w) / len(w) for w in mixing.CURRICULUM] == [1, 2, 3]
    data = [(k, " ".join(["w"] * (1 + k % 5)), "abc"[k % 3]) for k in range(6000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    words = Counter()
    for r in got:
        words[r["source"], int(r["position"] * 4)] += len(r["text"].split())
    for s, w in zip("abc", mixing.CURRICULUM, strict=True):
        total = sum(words[s, p] for p in range(4))
        assert all(abs(words[s, p] / total - w[p] / sum(w)) < 0.01 for p in range(4))


def test_query_comes_in_order_of_first_use(spark):
    got = [r["first_position"] for r in registry.queries()["op3_mix_sources"](spark, SF).collect()]
    assert got == sorted(got, key=lambda p: -1 if p is None else p) and 0 < sum(p is not None for p in got)


# 4 -------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    random.seed(6)
    texts = [t for _, t, *_ in ODD[:-1]] + [" ".join(random.choice(["A", "bé", "c\x85d", "É"]) for _ in range(random.randint(0, 30))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def around(kind):
    """Fingerprints: some small groups, or one crowd of near copies, or a crowd of words 3 bits apart in one part of the bits."""
    random.seed(7)
    fps = set()
    if kind == "far":  # a Hamming code: no two words are nearer than 3 bits, most have some at 3
        for k in range(1 << 11):
            word, places = 0, [p for p in range(1, 16) if p & (p - 1)]
            for j, p in enumerate(places):
                word |= (k >> j & 1) << p
            for c in (1, 2, 4, 8):
                word |= ((word & sum(1 << p for p in range(1, 16) if p & c)).bit_count() & 1) << c
            fps.add(word >> 1)
        return sorted(fps)
    if kind == "crowd":
        base = random.getrandbits(64)
        for _ in range(1500):
            x = base
            for _ in range(random.randint(0, 5)):
                x ^= 1 << int(random.triangular(0, 64, 5))
            fps.add(x)
    if kind == "spread":  # few links of 1 or 2 bits, many of 3, over all parts
        while len(fps) < 1500:
            x = sum(1 << k for k in random.sample(range(0, 64, 4), 5)) | (random.getrandbits(3) << 61)
            if all((x ^ y).bit_count() > 2 for y in fps):
                fps.add(x)
            elif random.random() < 0.002:
                break
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(random.choice([1, 3, 30])):
            x = base
            for _ in range(random.randint(0, 4)):
                x ^= 1 << random.randrange(64) if random.random() < 0.5 else 1 << random.randrange(6)
            fps.add(x)
    return sorted(fps)


@pytest.mark.parametrize("kind", ["groups", "crowd", "spread", "far"])
def test_links_lose_nothing(spark, kind):
    fps = around(kind)
    x = spark.createDataFrame([(simhash._long(f),) for f in fps], "fp long")
    got = simhash.links(x).collect()
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 3 for r in got)
    parent = {f: f for f in fps}

    def find(f, p):
        while p[f] != f:
            p[f] = p[p[f]]
            f = p[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a, parent)] = find(b, parent)
    mine = {f: f for f in fps}
    for r in got:
        mine[find(r["u"] & (2**64 - 1), mine)] = find(r["v"] & (2**64 - 1), mine)
    groups = lambda p: sorted(sorted(f for f in fps if find(f, p) == r) for r in {find(f, p) for f in fps})
    assert groups(parent) == groups(mine)


def test_components(spark):
    random.seed(8)
    edges = [(k, k + 1) for k in range(60)] + [(100 + random.randrange(50), 100 + random.randrange(50)) for _ in range(40)] + [(5, 5), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                k = todo.pop()
                if k not in want:
                    want[k] = n
                    todo += near[k]
    assert got == want


def test_simhash_dedup_keeps_one_of_each_group(spark, odd):
    kept = simhash.simhash_dedup(odd).collect()
    found = simhash.near_duplicates(odd).collect()
    assert len(kept) == len({r["component"] for r in found})
    assert {(r["doc_id"], r["text"]) for r in kept} >= {(3, "a b c"), (7, None)}


# 5 -------------------------------------------------------------------------------------------------------------------


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_after_insertions(spark):
    shared = prose(120, 1)
    data = [(k, prose(80, 10 + k)) for k in range(20)]
    data += [(50, prose(30, 90) + " " + shared + " " + prose(30, 91)), (51, prose(17, 92) + " inserted " + shared), (52, shared + " " + prose(5, 93)), (53, None), (54, ""), (None, shared), (None, prose(50, 94)), (None, prose(50, 94)), (52, prose(90, 95))]
    x = spark.createDataFrame(data, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(x).collect()
    assert {r["id"] for r in spans} == {51, 52, None} and {r["first_id"] for r in spans} == {50}
    texts = dict(data[:-1]) | {None: shared}
    for r in spans:
        assert texts[r["id"]].encode()[r["start"] : r["start"] + r["length"]].decode() in texts[50]
        assert r["length"] > 0.6 * len(shared)
    got = Counter((r["doc_id"], r["text"]) for r in substring_dedup.substring_dedup(x).collect())
    assert all(got[k, texts[k]] for k in [*range(20), 50, 53, 54]) and got[None, prose(50, 94)] == 2 and got[52, prose(90, 95)] == 1
    assert sum(got.values()) == len(data) and not got[52, texts[52]] and not got[None, shared]


def slow_chunks(data):
    """By the definition: a hash of the 16 bytes before each place; places that fit, unless one less than 16 bytes before fits, or 96 bytes."""
    fits = []
    for i in range(16, len(data) + 1):
        h = 0
        for b in data[i - 16 : i]:
            h = (2 * h + int(substring_dedup.NUMBERS[b])) % (1 << 32)
        if (h >> 7) % 8 == 0:
            fits.append(i)
    cuts = {f for f, before in zip(fits, [-16, *fits], strict=False) if f - before >= 16} | {len(data)}
    out, at = [], 0
    for end in sorted(cuts - {0}):
        while end - at > 96:
            out.append((at, at + 96))
            at += 96
        out.append((at, end))
        at = end
    return out


@pytest.mark.parametrize("within", [False, True])
def test_substring_spans_against_brute_force(spark, within):
    r = random.Random(21)
    parts = [prose(r.randint(10, 60), 200 + k) for k in range(12)] + ["é" * 90, "For " * 60, "-" * 300]
    data = [(k, " ".join(r.choice(parts) for _ in range(r.randint(1, 6))) + prose(r.randint(0, 3), k)) for k in range(40)] + [(40, None), (41, ""), (None, parts[0] + parts[1]), (7, parts[2] + "x")]
    repeats = [data[9], data[-2]]  # whole rows again
    owner, again = {}, []
    for k, t in data:
        b, seen = (t or "").encode(), set()
        for a, e in slow_chunks(b):
            c = b[a:e]
            if k is not None:
                owner[c] = min(owner.get(c, k), k)
            again.append(c in seen)
            seen.add(c)
    want, flags = Counter(), iter(again)
    for k, t in data:
        b, run = (t or "").encode(), None
        for a, e in [*slow_chunks(b), (None, None)]:
            first = owner.get(b[a:e]) if e is not None else None
            flag = next(flags) if e is not None else False
            if first is not None and (k is None or k > first or (within and flag)):
                run = [a, e, 1, first] if run is None else [run[0], e, run[2] + 1, min(run[3], first)]
            elif run is not None:
                if run[1] - run[0] >= 80:
                    want[k, run[0], run[1] - run[0], run[2], run[3]] += 1
                run = None
    got = substring_dedup.repeated_spans(spark.createDataFrame(data + repeats, "doc_id long, text string"), within=within)
    assert Counter(tuple(x) for x in got.drop("key").collect()) == want and len(want) > 10


def test_chunks_cover_texts():
    random.seed(3)
    for n in (0, 1, 15, 16, 17, 5000):
        data = bytes(random.randrange(97, 105) for _ in range(n))
        ends = substring_dedup.chunk_ends(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == n and max(np.diff([0, *ends]), default=0) <= substring_dedup.MOST
    again = substring_dedup.chunk_ends(b"xyz" + data)
    assert len({len(data) - e for e in ends} & {len(data) + 3 - e for e in again}) > 0.8 * len(ends)


# 6 -------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    data = [
        ("http://a.ORG/x?y#z", "a.ORG".lower(), "/x", "org/", "allow"), ("https://w.example.org/es/1", "w.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org", "example.org", "", None, "allow"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("x.com/de/", "", "", None, "allow"), ("http://x.com/de/?q", "x.com", "/de/", "com/de/", "block"),
        ("http://x.net/XXX-casino", "x.net", "/XXX-casino", None, "block"), ("http://x.net/casino", "x.net", "/casino", None, "allow"), ("http://x.net/casino/poker", "x.net", "/casino/poker", None, "block"),
        ("http://x.net/casino/casino", "x.net", "/casino/casino", None, "allow"), ("http://x.net/sussex", "x.net", "/sussex", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    x = spark.createDataFrame([(k, d[0]) for k, d in enumerate(data)], "page_id long, url string")
    got = url_filter.judge_urls(x).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == data


# 7 -------------------------------------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    x = spark.createDataFrame([(k, ["a", "a", "a", "b", None][k % 5]) for k in range(3203)], "doc_id long, source string")
    got = sharding.interleave(x, 16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [len(by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 3203
    assert all(sorted(r["slot"] for r in by[k]) == list(range(len(by[k]))) for k in range(16))
    for k in range(16):
        n = Counter(r["source"] for r in by[k])
        assert abs(n["a"] - 120) <= 3 and abs(n["b"] - 40) <= 3 and abs(n[None] - 40) <= 3
    assert sorted(map(str, got)) == sorted(map(str, sharding.interleave(x.repartition(9), 16).collect()))
    # By the definition: ranks by hash within a source, fractional ranks over all, equal cuts.
    h = {k: int(hashlib.md5(f"shard-1|{k}".encode()).hexdigest()[:15], 16) for k in range(3203)}
    of = defaultdict(list)
    for r in sorted(got, key=lambda r: h[r["doc_id"]]):
        of[r["source"]].append(r["doc_id"])
    order = sorted(((2 * i + 1) / (2 * len(ks)), s is not None, s or "", h[k], k) for s, ks in of.items() for i, k in enumerate(ks))
    places = {k: i for i, (*_, k) in enumerate(order)}
    starts = [3203 * k // 16 for k in range(17)]
    assert all(places[r["doc_id"]] == starts[r["shard"]] + r["slot"] < starts[r["shard"] + 1] for r in got)
    few = sharding.interleave(x.where("doc_id < 3"), 16).collect()
    assert sorted((r["slot"]) for r in few) == [0, 0, 0]


# 8 -------------------------------------------------------------------------------------------------------------------


def covered(texts, length=400):
    where = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


@pytest.mark.parametrize("most", [1 << 22, 2000])
def test_suffix_dedup(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", most)
    p = [prose(150, k) for k in range(4)]
    texts = [p[0] + " " + prose(60, 11), prose(30, 12) + p[0][:405] + prose(40, 13), p[1], p[1], p[1] + "é" + p[2], "For " * 300, "x" + "For " * 120, prose(200, 14), p[2][:399], None, "", "漢字" * 400, p[3] + p[3], p[3][5:404] + "!"]
    data = [(k, t) for k, t in enumerate(texts)] + [(7, prose(200, 14)), (None, p[2])]
    x = spark.createDataFrame(data, "doc_id long, text string")
    save(x, str(tmp_path))
    got = Counter(tuple(r) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect())
    raw = [(t or "").encode() for _, t in data]
    want = Counter()
    for (k, _), t, m in zip(data, raw, covered(raw), strict=True):
        spans = int((np.diff(np.concatenate([[0], m.astype("i1")])) == 1).sum())
        want[(k, len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, "u1")[~m].tobytes()).hexdigest(), spans > 0)] += 1
    assert got == want


def test_corpus_order_of_random_shards():
    random.seed(3)
    for _ in range(60):
        letters = random.choice([b"ab", b"abcdefgh", b"a", bytes(range(256))])
        base = [bytes(random.choice(letters) for _ in range(random.randint(30, 400))) for _ in range(3)]
        pieces, shards = [], []
        for _ in range(random.randint(1, 8)):
            x = bytearray(b"".join(random.choice(base)[random.randint(0, 40) :] for _ in range(random.randint(1, 3))))
            if x and random.random() < 0.5:
                x[random.randrange(len(x))] = random.choice(letters)
            pieces.append(bytes(x) + b"x" * max(0, 48 - len(x)))
            shards.append(random.randint(0, 2))
        where = Counter((s, p[i : i + 48]) for p, s in zip(pieces, shards, strict=True) for i in range(len(p) - 47))
        for p, s, mask in zip(pieces, shards, suffix_dedup.repeated_places(pieces, shards, 48), strict=True):
            assert mask.tolist() == [where[(s, p[i : i + 48])] > 1 for i in range(len(p) - 47)]


def test_segments_hold_every_stretch_once():
    random.seed(4)
    for letters in (b"a", b"ab", bytes(range(256))):
        data = bytes(random.choice(letters) for _ in range(9000))
        got = [i for _, a, b, _ in suffix_dedup.segments_of(data) for i in range(a, b - 399)]
        assert got == list(range(len(data) - 399))


# 9 -------------------------------------------------------------------------------------------------------------------


def slow_matches(docs, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in docs:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            x = split(text)
            n = min(13, len(x))
            for i in range(len(x) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(name))
        out.append((len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, monkeypatch):
    r = random.Random(9)
    words = ["the", "A", "of", "x1", "é", "日本"]
    item = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, item(30)), (2, item(13)), (3, item(12)), (4, "Only, three WORDS"), (5, None), (6, "..."), (10, item(40))]
    docs = [items[0][1] + " tail", "head; " + items[0][1][4:], item(60) + items[1][1].upper(), prose(50, 5) + " only three words " + prose(50, 6), prose(400, 7) + " " + items[6][1], None, "", items[2][1], item(300), "only three", " ".join(["the"] * 40)]
    x = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow_matches(docs, items)
    for block in (decontamination.BLOCK_BYTES, 100):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        found = decontamination.find_hits(x, b).orderBy("doc_id").collect()
        assert [(f["n_words"], f["n_hit"], f["items"], f["contaminated"]) for f in found] == want
        kept = [f["doc_id"] for f in decontamination.decontaminate(x, b).orderBy("doc_id").collect()]
        assert kept == [k for k, w in enumerate(want) if not w[3]]
        matched = decontamination.find_matches(x, b).orderBy("doc_id").collect()
        covers = [{m["doc_start"] + i for m in f["matches"] for i in range(m["n_words"])} for f in matched]
        assert [(len(c), sorted({m["item_id"] for m in f["matches"]})) for c, f in zip(covers, matched, strict=True)] == [w[1:3] for w in want]
    best = [m for m in matched[0]["matches"] if m["item_id"] == "1" and m["doc_start"] == 0]
    assert max(m["n_words"] for m in best) == 30  # the longest verbatim match is one


def test_decontamination_holds_one_block_at_a_time(spark, monkeypatch):
    """Over 50 blocks: each broadcast is destroyed before the next, the answer's plan searches nothing, rows may repeat."""
    items = [(k, prose(20, 1000 + k)) for k in range(120)]
    docs = [(k % 7 or None, prose(30, k) + " " + items[k * 5 % 120][1] + (" " + items[k][1] if k % 2 else "")) for k in range(20)] + [(3, None), (3, "")]
    x, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    alive, most = set(), []
    broadcast = spark.sparkContext.broadcast

    def watched(block):
        shared = broadcast(block)
        alive.add(shared)
        most.append(len(alive))
        destroy = shared.destroy
        monkeypatch.setattr(shared, "destroy", lambda: (alive.discard(shared), destroy()), raising=False)
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", watched)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    found = decontamination.find_hits(x, b)
    assert len(most) > 50 and max(most) == 1 and not alive
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    got = sorted((f["n_words"], f["n_hit"], f["items"], f["contaminated"]) for f in found.collect())
    assert got == sorted(slow_matches([t for _, t in docs], items))


def test_repeated_words_take_no_product_of_places():
    block = decontamination.Block([("a", "go " * 20_000), ("b", "go " * 13)])
    mask, pairs = decontamination.Shard(["go " * 50_000, "stop go", None, "x " + "go " * 13], block).hits()
    assert mask.sum() == 50_013 and pairs.tolist() == [[0, 0], [0, 1], [3, 0], [3, 1]]


def test_decontamination_query_on_data(spark):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60").collect()}
    items = [tuple(d) for d in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in registry.queries()["op9_decontamination"](spark, SF).collect()}
    for (k, _), (n, hit, names, bad) in zip(docs.items(), slow_matches(docs.values(), items), strict=True):
        g = got[k]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bad)


# 10 ------------------------------------------------------------------------------------------------------------------


def test_grams_are_those_of_each_text_alone(monkeypatch):
    texts = ["Ab, c", "", "x" * 50, "日本 語", "a", None, prose(400, 3), "É" + prose(9, 4)]
    for chunk in (7, 60, 1000, 1 << 18):  # texts in one part, in several, and in stretches
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        found = [set() for _ in texts]
        for which, bucket in toxicity.gram_hits(texts, None):
            for k, b in zip(which.tolist(), bucket.tolist(), strict=True):
                assert b not in found[k]
                found[k].add(b)
        assert found == [slow_buckets(t) for t in texts] and found[1] == found[5] == set()
    wanted = np.zeros(toxicity.DIM, bool)
    wanted[list(slow_buckets(texts[0]))[:3]] = True
    assert sum(len(b) for _, b in toxicity.gram_hits(texts[:2], wanted)) == 3


def slow_buckets(text):
    """By the definition: blanks for all ASCII characters but letters and digits, one at each end, and a hash of 64 bits."""
    plain = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in f" {(text or '').lower()} ")
    out, full = set(), (1 << 64) - 1
    for n in (4, 5, 6):
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & full
            out.add((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & full) >> 44)
    return out


def test_model_is_that_of_the_definition(spark, monkeypatch):
    """Log-count ratios, the choice of buckets and the scores, against plain Python."""
    monkeypatch.setattr(toxicity, "SELECTED", 40)
    r = random.Random(12)
    bad, good = ["vile", "nasty", "scum"], ["tree", "river", "stone", "cloud"]
    data = [(" ".join(r.choice(bad if k % 3 == 0 and r.random() < 0.5 else good) for _ in range(12)), int(k % 3 == 0)) for k in range(60)]
    model = toxicity.fit(spark.createDataFrame(data, "text string, y int"))
    counts = [Counter(b for t, y in data if y == k for b in slow_buckets(t)) for k in (0, 1)]
    totals = [sum(c.values()) + toxicity.DIM for c in counts]
    sure, ratios = {}, {}
    for b in counts[0].keys() | counts[1].keys():
        ratios[b] = math.log((counts[1][b] + 1) / totals[1]) - math.log((counts[0][b] + 1) / totals[0])
        if counts[0][b] + counts[1][b] >= 3:
            sure[b] = abs(ratios[b]) / math.sqrt(1 / (counts[1][b] + 1) + 1 / (counts[0][b] + 1))
    chosen = sorted(sorted(sure, key=lambda b: (-round(sure[b], 9), b))[:40])
    grams = [[chosen.index(b) for b in sorted(slow_buckets(t)) if b in set(chosen)] for t, _ in data]
    weights, bias = toxicity.regress(np.array(sum(grams, []), "u2"), np.array([len(g) for g in grams]), np.array([y for _, y in data], "f8"), np.array([ratios.get(b, 0.0) for b in range(toxicity.DIM)]), np.array(chosen))
    assert sorted(np.flatnonzero(model.weights).tolist()) == chosen and abs(model.bias - bias) < 1e-6
    for t, _ in data[:20] + [("vile river", 1), ("", 0), (None, 0)]:
        z = bias + sum(weights[b] for b in slow_buckets(t))
        assert abs(model.score([t])[0] - 1 / (1 + math.exp(-z))) < 1e-5


def test_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.1")
    got = {r["doc_id"]: r for r in registry.queries()["op10_toxicity"](spark, d).collect()}
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").collect()]
    out = [(got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _ in labels)
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert sum(p and y for p, y in out) > 0.8 * sum(y for _, y in out)
    assert sum(p and not y for p, y in out) < 0.02 * len(out)


def test_a_hot_id_costs_no_other_label(spark):
    """One id of more rows than are learnt from, and some of many rows: all others are still learnt from, and reruns agree."""
    rows = [(7, f"hot {k}") for k in range(1300)] + [(8, f"warm {k}") for k in range(300)] + [(k, f"own {k}") for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).distinct()
    chosen = [sorted(r["text"] for r in toxicity.training_rows(df, labels, F.lit(True), max_train=1000).collect()) for _ in range(2)]
    assert chosen[0] == chosen[1] == sorted(t for i, t in rows if i != 7)


def test_no_labels_reject_nothing(spark, odd):
    assert toxicity.drop_toxic(odd, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(ODD)


# Pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.cut(stage(spark, before, SF))
        assert after.columns == docs.columns and after.count() > 0
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in registry.queries()["op10_toxicity"](spark, SF).collect()}
            assert {r["doc_id"] for r in after.collect()} == {k for k, p in scores.items() if not p}
        elif name == "simhash":
            c = simhash.near_duplicates(before).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in c}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            rows = before.select("doc_id", "text").collect()
            bad = {r["doc_id"] for r, m in zip(rows, slow_matches([r["text"] for r in rows], items), strict=True) if m[3]}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in rows} - bad
        else:
            words = lambda d: d.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert abs(words(after) - words(before)) < 0.2 * words(before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count()
    mixing.mix(docs).drop("position").write.parquet(f"{tmp_path}/mixed")
    last = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).orderBy("start").collect()
    assert [r["doc_id"] for r in last] == [r["doc_id"] for r in mixing.mix(docs).collect()]  # files in training order


def test_pipeline_order_goes_by_the_number_of_a_file(spark, tmp_path):
    import corpus_pipeline
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, ids in (("part-100000-b", [3, 1]), ("part-99999-b", [7, 2]), ("part-00002-a", [9]), ("other", [5])):
        rows = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [f"text {i}" for i in ids], "source": ["s"] * len(ids), "lang": ["en"] * len(ids)})
        pq.write_table(rows, f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.token_files(spark, spark.read.parquet(str(tmp_path)), SF).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [5, 9, 7, 2, 3, 1]


def test_pipeline_on_odd_rows(spark, odd_dir, empty_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert corpus_pipeline.run(spark, odd_dir).count() > 0
