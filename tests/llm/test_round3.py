"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from procuris.llm import audit, negatives, wordbpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for x, _, words in docs if x == lang for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= least)
        v = len(kept)

        def shares(words):
            n = Counter(w for w in words if w in set(kept))
            return n, [1 + 1_000_000_000 * (n[w] + 2) // (n.total() + 2 * v) for w in kept]

        groups = {s: shares([w for x, y, words in docs if (x, y) == (lang, s) for w in words]) for s in {y for x, y, _ in docs if x == lang}}
        _, whole = shares([w for x, _, words in docs if x == lang for w in words])
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (n, p) in groups.items():
            pairs = sorted(((-sum(map(f, p, q)), t.encode()) for t, (_, q) in groups.items() if t != s))
            terms = sorted((-f(a, b), w.encode()) for w, a, b in zip(kept, p, whole) if n[w] and a > b)[:top]
            out += [(lang, s, part, item.decode(), -value, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["Alpha", "beta", "ÉTÉ", "été", "漢字", "don't", "x1y", "Zz", "the", "of", "naïve", "rare"]
    rows = [(" ".join(r.choice(words[:r.randint(2, 12)]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "ä", None, ""])) for _ in range(220)]
    rows += [(None, "en", "a"), ("", "none", "only"), ("alone", "none", "second"), ("word " * 20000, "en", "long"), ("one", "single", "s")]
    return rows + rows[:5]


@pytest.mark.parametrize("stretch, block, held", [(1 << 14, 128, 400_000), (3, 2, 5)])
def test_divergence_is_the_plain_one(spark, texts, monkeypatch, stretch, block, held):
    monkeypatch.setattr(audit, "STRETCH", stretch)
    monkeypatch.setattr(audit, "HELD", held)
    monkeypatch.setattr(audit.pair_sums, "__defaults__", (block,))
    df = spark.createDataFrame([(*x, "n", 1) for x in texts], "text string, lang string, source string, term string, n int").repartition(5)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit.divergence(df).collect())
    assert got == plain_divergence(texts, 10, 10)


def test_divergence_of_nothing_and_of_large_counts(spark):
    assert audit.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    big = 9_000_000_000_000
    got = spark.range(1).select(audit.share(F.lit(big), F.lit(3 * big + 1), F.lit(1000)).alias("p"), audit.gap(F.lit(1_000_000_001).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert (got["p"], got["f"]) == (1 + 1_000_000_000 * (big + 2) // (3 * big + 1 + 2000), (10**9) ** 2 // (10**9 + 2))


def test_runs_are_intersected():
    r = np.random.default_rng(1)
    for size in (1, 2, 50):
        dense = r.integers(1, 4, (2, size)) * 10**8
        runs = [(np.flatnonzero(np.append(True, x[1:] != x[:-1])), x) for x in dense]
        (s, p), (t, q) = ((at, x[at]) for at, x in runs)
        assert audit.pair_sum(s, p, t, q, size) == sum((a - b) ** 2 // (a + b) for a, b in zip(*dense.tolist()))


def plain_negatives(rows):
    import math

    good = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m == lab) for b, (j, m, w) in enumerate(good) if b != a and len(w) == len(v))
        for ps, none, j, _ in [s for s in scored if s[3]][:5]:
            found = [s for s in scored if not s[3] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(i, None if none else j, rank, None if s[1] else s[2], -ps, -s[0]) for rank, s in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_are_the_plain_ones(spark, monkeypatch, small):
    if small:  # many blocks, tiles and refined levels
        monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
        monkeypatch.setattr(negatives, "MOST_ANCHORS", 2)
        monkeypatch.setattr(negatives, "TILE_ANCHORS", 2)
        monkeypatch.setattr(negatives, "TILE_ROWS", 7)
    r = np.random.default_rng(6)
    lead = r.normal(size=(12, 20))
    rows = [(i, (lead[r.integers(12)] * r.uniform(0.2, 1) + r.normal(size=20) * 0.3).round(2).tolist(), int(r.integers(10))) for i in range(600)]
    rows += [(i, lead[0].tolist(), i % 3) for i in range(600, 700)]  # equal vectors: ties go by id
    rows += [(700, [1.0] * 20, None), (800, None, 1), (900, [1.0, None], 2), (1000, [float("nan")] * 20, 2), (1100, [1.0, 2.0], 5), (1101, [1.0, 1.9], 5), (1102, [0.5, 0.8], 6), (None, lead[0].tolist(), 0), (None, lead[0].tolist(), 1),
             (1200, [], 3), (1201, [], 3), (1203, [], 4), (1300, [1e7] * 20, 3), (200, lead[1].tolist(), 1), (100, lead[0].tolist(), 1), (100, lead[0].tolist(), 1)]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "vec_id long, embedding array<double>, label int, no string, score int").repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0, moved)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_negatives([x for x in rows if x[0] != 1300])
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    import pyarrow as pa

    for width in (1, 5, 16, 40):
        v = r.integers(-300, 300, (60, width))
        mean, dev = negatives.summaries(v.astype(float))
        part = pa.table({"no": np.arange(60), "label": np.zeros(60, np.int64), "v": pa.array(list(v), pa.list_(pa.int64())), "mean": pa.array(list(mean)), "dev": pa.array(list(dev))})
        side = negatives.Side(part, np.arange(60), width)
        exact, spans = v @ v.T, []
        for m, d in side.levels:
            middle, reach = m @ m.T, d @ d.T
            assert (np.abs(exact - middle) <= reach + 1e-6 * np.abs(exact).max()).all()
            spans.append(reach.mean())
        assert spans == sorted(spans, reverse=True)  # finer segments bound closer


def test_word_table(spark, monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [None, "", " \n\t ", "Hello wörld's", "<|endoftext|> it's<|startoftext|>x <|ENDOFTEXT|>", "İSTANBUL ΟΔΟΣ ﬁ é é x́", "a b\x85c d", "x" * 5000, "日本語 テキスト 123", "\x00\x01 �",
             "!!! don't DON'T we'll", "word " * 30000, "Hello wörld's"]
    texts += [" ".join(r.choice(["Alpha", "béta", "gamma,", "1234", "the", "'s", "\U0001f600", "x̀y", "--"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i % 90, t, "row", "ids", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, ids string, n int").repartition(3)
    whole = Tokenizer.from_file(PATH)
    want = sorted((i % 90, i, "row", ids := whole.encode(t or "", add_special_tokens=False).ids, whole.decode(ids, skip_special_tokens=False)) for i, t in enumerate(texts))
    for group in (wordbpe.GROUP_BYTES, 2000):
        monkeypatch.setattr(wordbpe, "GROUP_BYTES", group)
        monkeypatch.setattr(wordbpe, "IDS_AT_ONCE", max(50, group >> 4))
        got = wordbpe.decode(wordbpe.encode(df, PATH), PATH)
        monkeypatch.setattr(wordbpe, "BUCKET_BYTES", group * 2)
        assert got.columns == ["doc_id", "row", "n", "ids", "decoded"]
        assert sorted((x["doc_id"], x["n"], x["row"], x["ids"], x["decoded"]) for x in got.collect()) == want
    assert wordbpe.encode(df.limit(0), PATH).count() == 0
    only = wordbpe.encode(df.select("text"), PATH)
    assert only.columns == ["ids"] and only.count() == len(texts)


def test_decode(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    ids = [whole.encode("Some words, and <|endoftext|> more", add_special_tokens=False).ids, [], None, [49407, 320, 10**6, 320], list(range(300))]
    df = spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in wordbpe.decode(df, PATH).collect()}
    assert got == {k: whole.decode([i for i in x or [] if i < 49408], skip_special_tokens=False) for k, x in enumerate(ids)}


def test_op13_digests(spark):
    got = {r["doc_id"]: r for r in wordbpe.op13(spark, "/root/testdata/sf0.001").collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), whole.decode(ids, skip_special_tokens=False))]
        assert [got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]] == [len(ids), *digest]
