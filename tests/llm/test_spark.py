"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from procuris.llm import common, egojoin, langid, linededup, mixing, omh, packing, rotation, simhash, toxicity, warczip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randint(0, 99)) for _ in range(n))
    base, shared = prose(60), prose(12)
    out = [(1, base + "\n" + shared), (2, base + "\n" + shared), (3, base.replace("alpha", "alphA", 1) + "\nown line of some length\n" + shared + "!"), (4, None), (5, ""), (6, " \n "), (7, "x"), (8, prose(20000)),
           (9, shared + "?"), (10, prose(30)), (10, prose(30))]
    return [(i, t, ["en", "fr", None][i % 3], ["s", None, "t"][i % 3], len(t or ""), 0.5, "k") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, rows, none):
    got = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [(i, simhash.fingerprint(t)) for i, t, *_ in rows]
    want = []
    for i, f in fps:
        seen, front = {i}, [f]
        while front:
            p = front.pop()
            for j, g in fps:
                if j not in seen and (p ^ g).bit_count() <= 4:
                    seen.add(j)
                    front.append(g)
        want.append((i, f - (1 << 64) if f >> 63 else f, min(seen)))
    assert got == sorted(want)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_of_repeated_and_null_ids(spark):
    r = random.Random(8)
    a, b, c, d = (" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(80)) for _ in range(4))
    rows = [(2, a), (5, b), (5, a), (9, c), (9, c), (None, d), (None, d), (None, a), (None, None), (None, ""), (7, c)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, copy string").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(2, a), (5, b), (7, c), (0, d), (0, "")])
    unique = spark.createDataFrame([(2, a), (5, b), (4, a), (None, a)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(unique).collect()) == [2, 5]


def test_hot_bucket_links(spark):
    base = 0x0123456789ABCDEF
    fps = [(base ^ (1 << a) ^ (1 << b), 64 * a + b) for a in range(40) for b in range(a)]
    df = spark.createDataFrame(fps, "fp long, rep long")
    got = common.components(simhash.near_links(df, block=64)).select("root").distinct().count()
    assert got == 1


@pytest.mark.parametrize("agree", [1, 2, 3, None])
def test_near_links_are_all_links(spark, agree):
    r = np.random.default_rng(4)
    fps = r.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, *(fps[:200] ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for b, c in ((3, 60), (7, 8), (31, 33)))]))
    root = common.local_components(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4))
    df = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long").repartition(3)
    got = {x["node"]: x["root"] for x in common.components(simhash.near_links(df, agree=agree, block=16)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == root.tolist()


def kept_texts(rows, tau=linededup.TAU, least=linededup.LEAST):
    """(id, text) of rows after the removal of repeated lines, word for word."""
    import xxhash

    from tests.llm.test_pure import edits

    def signed_hash(text):  # the engine's hash of the text, and of whether it is null; null ids stand first
        one = xxhash.xxh64_intdigest((text or "").encode(), 42)
        two = xxhash.xxh64_intdigest((1 if text is None else 0).to_bytes(4, "little"), one)
        return two - ((two >> 63) << 64)

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, signed_hash(rows[i][1])))
    spoken = [x for _, t in rows for x in (t or "").split("\n") if x.strip(" \n\t")]
    classes = list(dict.fromkeys(spoken))
    a, b = zip(*[(i, j) for i in range(len(classes)) for j in range(i) if min(len(classes[i]), len(classes[j])) >= least and abs(len(classes[i]) - len(classes[j])) <= tau and edits(classes[i], classes[j]) <= tau] or [(0, 0)])
    root = dict(zip(classes, common.local_components(len(classes), np.array(a), np.array(b)).tolist()))
    seen, out = set(), {}
    for i in order:
        lines = []
        for x in (rows[i][1] or "").split("\n"):
            if not x.strip(" \n\t") or root[x] not in seen:
                lines.append(x)
            if x.strip(" \n\t"):
                seen.add(root[x])
        out[i] = None if rows[i][1] is None else "\n".join(lines)
    return [(rows[i][0], out[i]) for i in range(len(rows))]


def told(rows):
    return sorted((str(i), str(t)) for i, t in rows)


def test_lines(docs, rows, none):
    cut = linededup.without_repeats(docs)
    assert cut.columns == docs.columns
    assert told((r["doc_id"], r["text"]) for r in cut.collect()) == told(kept_texts([(i, t) for i, t, *_ in rows]))
    got = {(r["doc_id"], r["at"]) for r in linededup.repeated_lines(docs).collect()}
    assert (2, 0) in got and (1, 0) not in got
    assert linededup.without_repeats(none).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    line, other = "a line of more than twenty letters", "a second line that is quite another"
    rows = [(1, line), (10, line + "\n" + other), (10, "a wholly unique first line of its own\n" + other + "!"), (20, "one more line that is copied whole"), (20, "one more line that is copied whole"),
            (None, "what stands under no id at all, twice"), (None, "what stands under no id at all, twice"), (None, "a line under no id that is its own"), (None, None), (30, None), (31, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone string").repartition(4)
    cut = linededup.without_repeats(df)
    assert cut.columns == df.columns
    got = told((r["doc_id"], r["text"]) for r in cut.collect())
    assert got == told(kept_texts(rows))
    assert ("10", "a wholly unique first line of its own\n") in [(i, t[:len("a wholly unique first line of its own\n")]) for i, t in got] or ("10", "a wholly unique first line of its own") in got
    report = linededup.line_report(df)
    assert report.count() == len(rows)
    assert sorted(r["n_repeated"] for r in report.filter("doc_id = 20").collect()) == [0, 1]


def test_order_minhash(docs, rows, none):
    every = omh.fingerprint_documents(docs).collect()
    assert len(every) == len(rows)
    got = {r["doc_id"]: r for r in every}
    texts = sorted({(i, t or "") for i, t, *_ in rows})
    for n, (i, t) in enumerate(texts):
        if i in (9, 10):  # rows of one id follow each other by a hash
            continue
        cut = len(t) // 4
        changed = t[:len(t) - cut] + texts[(n + 1) % len(texts)][1][:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert got[4]["fingerprint"] == got[5]["fingerprint"]
    assert got[8]["near_edited"] > 0.1 > got[8]["near_next"]
    assert omh.fingerprint_documents(none).count() == 0


def test_order_minhash_repeated_and_null_ids(spark):
    words = lambda n: " ".join(f"w{(n * i) % 97}" for i in range(60))
    rows = [(1, words(5)), (2, words(7)), (2, words(11)), (2, words(11)), (3, words(7)), (None, words(7)), (None, words(13)), (None, None)]
    got = omh.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = sorted({t or "" for _, t in rows})
    alone = {texts[r["doc_id"]]: r["fingerprint"] for r in omh.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sorted((str(r["doc_id"]), r["n_chars"], r["fingerprint"]) for r in got) == sorted((str(i), len(t or ""), alone[t or ""]) for i, t in rows)


def plain_signature(text, tuples=omh.TUPLES):
    """Order MinHash word for word, with the hashes that Spark has."""
    import struct

    import xxhash

    def chained(*values):  # xxhash64 of several columns: each one's hash seeds the next
        seed = 42
        for v, width in values:
            seed = xxhash.xxh64_intdigest(v if width == 0 else struct.pack("<q" if width == 8 else "<i", v), seed)
        return seed - ((seed >> 63) << 64)

    def murmur(*values):  # hash() of longs
        rot, mask, h = lambda x, r: (x << r | x >> (32 - r)) & mask, 0xFFFFFFFF, 42
        for v in values:
            for k in (v & mask, v >> 32 & mask):
                h = (rot(h ^ rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
            h ^= 8
            h = (h ^ h >> 16) * 0x85EBCA6B & mask
            h = (h ^ h >> 13) * 0xC2B2AE35 & mask
            h ^= h >> 16
        return h

    words = [chained((w, 0)) for w in (text or "").encode().split()]
    grams = [chained(*((h, 8) for h in words[i:i + omh.K])) for i in range(max(1, len(words) - omh.K + 1))] if words else []
    seen, elements = {}, []
    for at, g in enumerate(g >> omh.PLACE_BITS for g in grams):
        seen[g] = seen.get(g, 0) + 1
        elements.append((chained((g, 8), (seen[g], 4)), at))
    out = []
    for n in range(tuples):
        order = sorted((chained((e, 8), (n, 4)) >> omh.PLACE_BITS, at) for e, at in elements)
        two = sorted((order[0], order[-1]), key=lambda x: x[1]) if order else []
        out.append(murmur(*(h for h, _ in two)) if two else 0)
    return "".join(f"{x:08x}" for x in out)


def test_order_minhash_is_the_plain_one(docs, rows, none):
    got = sorted((r["doc_id"], r["fingerprint"]) for r in omh.fingerprint_documents(docs).collect())
    assert got == sorted((i, plain_signature(t)) for i, t, *_ in rows)


def test_hot_ids_are_parted(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(150, f"hot {i}") for i in range(4000)] + [(None, f"none {i}") for i in range(3000)] + [(151, f"warm {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = omh.bucketed(df, "doc_id", rows=200)
    number = {(x["doc_id"], x["bucket"]): x["count"] for x in got.groupBy("doc_id", "bucket").count().collect()}
    assert len({b for i, b in number if i == 150}) >= 10 and max(number.values()) < 400
    order = [(x["doc_id"] is not None, x["doc_id"] or 0, x["h"], x["bucket"]) for x in got.withColumn("h", F.xxhash64("text")).collect()]
    buckets = [x[-1] for x in sorted(order)]
    assert buckets == sorted(buckets) and len(order) == len(rows)


def test_following_row_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(omh, "FAN", 3)
    ids = [n * n * n for n in range(200)]
    df, parts = omh.bucketed(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), "doc_id", rows=4)
    assert parts == 50 and max(r["count"] for r in df.groupBy("bucket").count().collect()) <= 12
    got = {r["doc_id"]: r["following"] for r in omh.with_next(df, ["doc_id"], "text", "following").collect()}
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:] + words[:100]))], "doc_id long, text string")
    got = omh.fingerprint_documents(df).first()
    assert 0.2 < got["near_next"] < 0.9  # nearly the same k-mers, half of the pairs in another order


def test_language(docs, none):
    model = langid.fit(docs)
    got = langid.label(docs, model, by_word=True)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "word_langs"]
    for r in got.collect():
        empty = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == empty and 0 <= r["score"] <= 1
    assert langid.label(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.label(docs, langid.fit(none)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    df, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(400)], "doc_id long, toxic int, quality int")
    kept = toxicity.drop_toxic(df, labels)
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i in range(400) if i % 4]
    scored = toxicity.score(docs, toxicity.fit(toxicity.labelled_rows(df, labels)))
    assert scored.count() == docs.count() and all(0 <= x["score"] <= 1 for x in scored.collect())
    assert {x["score"] for x in toxicity.score(docs, toxicity.fit(toxicity.labelled_rows(df, labels.limit(0)))).collect()} == {0.0}
    assert toxicity.drop_toxic(none, labels).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 16))
    v[100:200] = v[0] + r.normal(size=(100, 16)) * 0.25
    v[200:220] = v[1]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None]), (304, [1.0, 2.0]), (305, [2.0, 4.0])]
    old = egojoin.BLOCK, egojoin.INNER
    egojoin.BLOCK, egojoin.INNER = 32, 8
    try:
        got = {x["vec_id"]: x for x in egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    finally:
        egojoin.BLOCK, egojoin.INNER = old
    n = np.linalg.norm(v, axis=1)
    near = v @ v.T / np.outer(n, n) >= 0.95
    np.fill_diagonal(near, False)
    root = common.local_components(300, *np.nonzero(near))
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)
    assert [got[i]["n_links"] for i in range(300, 306)] == [0, 0, 0, 0, 1, 1] and got[305]["component_id"] == 304
    near = [(None, [1.0, 0.0]), (4, [1.0, 0.01]), (3, [1.0, 0.02]), (3, [1.0, 0.02]), (None, [0.0, -1.0]), (None, None)]
    got = egojoin.near_duplicates(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()
    assert sorted((x["vec_id"] or 0, x["n_links"], x["component_id"] or 0, x["kept"]) for x in got) == [(0, 0, 0, False), (0, 0, 0, False), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False)]
    assert egojoin.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing(docs, rows, none, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(mixing.with_quality(mixing.sized(docs), labels), F.col("_quality")).collect()
    assert len(got) == len(rows)
    sources = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sources.setdefault(r["source"], []).append(r)
    for rs in sources.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs) / 2 + 1
    assert abs(sum(rs[0]["target"] for rs in sources.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mixing.mixed_documents(docs, labels).columns == docs.columns
    assert mixing.mix(mixing.sized(none)).count() == 0


def test_packing(docs, rows, none):
    got = packing.pack_documents(docs).collect()
    made, want = packing.encoder(packing.tokenizer_path()), []
    for i, t, *_ in rows:
        ids = made.whole.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, p, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], np.uint32).tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for xs in by.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0


def test_clashing_columns(spark, docs, rows):
    clash = docs.withColumns({c: F.lit("?") for c in ("size", "target", "times", "taken", "source_size", "n", "sequence_id", "offset", "length", "_gone", "at", "class", "piece", "fp", "component_id", "root", "bucket", "no", "sha1")})
    count = len(rows)
    mixed = mixing.mix(mixing.sized(clash)).collect()
    assert len(mixed) == count and all(r["taken"] == r["times"] * r["size"] and r["_gone"] == "?" for r in mixed)
    cut = linededup.without_repeats(clash)
    assert cut.columns == clash.columns and cut.count() == count
    assert simhash.keep_one(clash).columns == clash.columns
    assert simhash.near_duplicates(clash).count() == omh.fingerprint_documents(clash).count() == count
    packed = packing.pack_documents(clash).collect()
    assert {r["doc_id"] for r in packed} == {i for i, *_ in rows}
    items = spark.createDataFrame([(1, 5, "?", "?"), (2, 7, "?", "?")], "doc_id long, length long, sequence_id string, offset string")
    assert sorted(r["offset"] for r in packing.pack(items, ["doc_id"]).collect()) in ([0, 5], [0, 7])
    assert mixing.mixed_documents(clash, spark.createDataFrame([], "doc_id long, quality int, toxic int")).columns == clash.columns


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, 0, None, "?"), (3, 1, "cy", "!")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r["conv_id"], r["speaker"]): r for r in rotation.joined(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "cy")}
    text = got[1, "ann"]["rendering"]
    assert text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert [text[m["start"]:m["end"]] for m in got[1, "ann"]["masks"]] == ["hi<|end|>\n", "bye<|end|>\n"]
    assert got[3, "cy"]["rendering"].startswith("<|user name=unknown|>\n?")
    assert rotation.rotate(df.limit(0)).count() == 0


def test_warc(spark):
    long = "é" * 600
    pages = [(1, "http://a", long, "x"), (2, None, long, "x"), (3, "http://c", "short", "x"), (4, "http://d", "short", "x"), (5, "http://e\r\nX: y", None, "x"), (6, "http://f", long + "!", "x")]
    got = {r["page_id"]: tuple(r)[1:] for r in warczip.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string, sha1 string").repartition(2)).collect()}
    digest = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    assert got == {1: (1200, digest(long), "revisit", 2), 2: (1200, digest(long), "response", None), 3: (5, digest("short"), "response", None), 4: (5, digest("short"), "response", None),
                   5: (0, digest(""), "response", None), 6: (1201, digest(long + "!"), "response", None)}
    assert warczip.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reads_ranges_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warczip, "READ_BYTES", 100)
    pages = spark.createDataFrame([(i, None, str(i) * 300, 1) for i in [*range(60), 7, 7]], "page_id long, url string, html string, size int").repartition(3)
    got = warczip.round_trip(spark, pages)
    assert got.rdd.getNumPartitions() >= 10
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == sorted([*range(60), 7, 7]) and {r["record_type"] for r in rows} == {"response"}


def test_null_ids_near_copies(spark):
    own = [" ".join(f"{c}{(n * i) % 89}" for i in range(50)) for n, c in ((3, "a"), (5, "b"), (7, "c"))]
    rows = [(1, own[0], "s"), (None, own[0], "s"), (None, own[1], "s"), (None, own[1], "s"), (None, own[2], "s"), (2, None, "s"), (None, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    fp = lambda t: (f := simhash.fingerprint(t)) - ((f >> 63) << 64)
    assert min((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a, b in ((own[0], own[1]), (own[0], own[2]), (own[1], own[2]))) > 4
    order = lambda xs: sorted(xs, key=str)
    got = simhash.near_duplicates(df).collect()
    assert order((r["doc_id"], r["fp"], r["component_id"]) for r in got) == order((i, fp(t), 1 if t == own[0] else 2 if not t else None) for i, t, _ in rows)
    assert order(tuple(r) for r in simhash.keep_one(df).collect()) == order([(1, own[0], "s"), (2, None, "s"), (None, own[1], "s"), (None, own[2], "s")])


def test_null_id_links(spark):
    text = " ".join(f"w{(7 * i) % 97}" for i in range(400))
    rows = [(None, text), (None, text + " w1"), (7, text + " w1 w2"), (None, "else")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=16).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["7", "7", "7", "None"]


def test_null_ids_mixing(spark):
    rows = [(i if i % 3 else None, "x " * (1 + i % 7), "st"[i % 2]) for i in range(60)] + [(None, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(mixing.with_quality(mixing.sized(df), labels), F.col("_quality")).collect()
    assert sorted((str(r["doc_id"]), r["text"], str(r["source"])) for r in got) == sorted((str(i), t, str(s)) for i, t, s in rows)
    for source in ("s", "t", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
    many = {}
    for r in got:
        many[str(r["doc_id"]), r["text"], str(r["source"])] = many.get((str(r["doc_id"]), r["text"], str(r["source"])), 0) + r["times"]
    taken = {}
    for r in mixing.mixed_documents(df, labels).collect():
        taken[str(r["doc_id"]), r["text"], str(r["source"])] = taken.get((str(r["doc_id"]), r["text"], str(r["source"])), 0) + 1
    assert taken == {k: n for k, n in many.items() if n} and any(k[0] == "None" for k in taken)


def test_null_ids_mixing_and_sql(spark, tmp_path):
    import duckdb

    rows = [(i if i % 4 else None, "x " * (1 + i % 7), "st"[i % 2]) for i in range(60)] + [(None, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    plain = lambda rs: sorted("|".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rs)
    assert plain(mixing.op8(spark, str(tmp_path)).collect()) == plain(con.execute(mixing.OP8_SQL).fetchall())


def test_null_ids_warc(spark):
    long, other = "é" * 600, "ü" * 600
    pages = [(1, "http://a", long), (None, "http://b", long), (None, "http://c", other), (None, None, other), (None, "http://d", "short"), (None, "http://e", None)]
    got = warczip.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    digest = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = [(1, digest(long), "response", None), (None, digest(long), "revisit", 1), (None, digest(other), "response", None), (None, digest(other), "response", None), (None, digest("short"), "response", None), (None, digest(""), "response", None)]
    assert sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted((str(a), b, c, str(d)) for a, b, c, d in want)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as pipe

    folder = "/root/testdata/sf0.001"
    out = common.table(spark, folder, "documents")
    names = out.columns
    for name, stage in pipe.STAGES:
        out = common.saved(stage(spark, out, folder))
        assert name == pipe.STAGES[-1][0] or out.columns == names
    assert out.count() > 100


def test_columns_of_like_names_stay(spark):
    names = ["_hash", "_no", "_times", "_n", "_quality", "_good", "n", "_key", "_part", "_rank", "_class", "_base", "_slot", "key", "hash", "number", "toxicity", "_toxicity", "part", "kind", "gone"]
    rows = [(i, f"text number {i} with some words " * 3, f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    by_id = {r[0]: r for r in rows}
    for made in (mixing.mixed_documents(df, labels), toxicity.drop_toxic(df, labels), simhash.keep_one(df), linededup.without_repeats(df.drop("text").withColumn("text", F.concat(F.lit("own line of this row: "), F.md5("_hash"))))):
        assert made.columns and set(made.columns) == set(df.columns)
        for r in made.collect():
            assert all(r[n] == by_id[r["doc_id"]][3 + k] for k, n in enumerate(names))
    packed = packing.pack(df.withColumn("length", F.lit(7)), ["doc_id"])
    assert all(r[n] == by_id[r["doc_id"]][3 + k] for r in packed.collect() for k, n in enumerate(names))
    mixed = mixing.mix(mixing.sized(df))
    assert set(df.columns) <= set(mixed.columns) and all(r["_key"] == f"_key{r['doc_id']}" and r["n"] == f"n{r['doc_id']}" for r in mixed.collect())


def test_fits_are_bounded_by_rows(spark):
    rows = [(None, f"das ist der text nummer {i} und noch mehr", "de") for i in range(900)] + [(None, f"this is the text number {i} and some more", "en") for i in range(900)]
    rows += [(1, "one row that is there again and again", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=60)
    assert sorted(model.langs) == ["de", "en"]
    got = {r["lang_pred"] for r in langid.label(df.filter("lang = 'de'"), model).collect()}
    assert got == {"de"}
