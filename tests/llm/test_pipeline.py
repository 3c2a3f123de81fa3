"""Each stage of the pipeline, and the scores of operators 1 and 5, against a plain version on a few whole documents."""

import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline as pipe
from procuris.llm import common, langid, linededup, mixing, packing, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.saved(common.table(spark, FOLDER, "documents").filter("doc_id < 90"))


def hashed(i):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return h - ((h >> 63) << 64)


def toxic_scores(rows, labels):
    """Scores of texts by weights fitted to labelled rows in the order of their hash."""
    cells = lambda t: np.unique(toxicity.features(*common.words(pa.array([t], pa.string())))[1])
    truth = defaultdict(int)
    for i, y in labels:
        if y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            truth[i] = max(truth[i], y)
    model = toxicity.fit_rows([(cells(t), truth[i]) for i, t in sorted(rows, key=lambda r: hashed(r[0])) if i in truth])
    weights = dict(zip(model.index.tolist(), model.value.tolist()))
    return {i: 1 / (1 + np.exp(-(sum(weights.get(c, 0.0) for c in cells(t).tolist()) + model.bias))) for i, t in rows}


def test_toxicity_stage(spark, docs):
    labels = [(r["doc_id"], r["toxic"]) for r in common.table(spark, FOLDER, "labels").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = toxic_scores(rows, labels)
    model = toxicity.fit(toxicity.labelled_rows(docs, common.table(spark, FOLDER, "labels")))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    kept = pipe.drop_toxic(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in want.items() if s < toxicity.THRESHOLD}


def test_line_stage(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    places = [(i, n, x) for i in sorted(texts) for n, x in enumerate((texts[i] or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    lines = sorted({x for _, _, x in places})
    by_size, root = defaultdict(list), {x: x for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in lines:
        if len(x) >= linededup.LEAST:
            near = [y for n in range(len(x) - 2, len(x) + 3) for y in by_size[n]]
            count = Counter(x)
            near = [y for y in near if sum(((count - Counter(y)) | (Counter(y) - count)).values()) <= 4]
            for y, hit in zip(near, linededup.edits_within([x] * len(near), near, 2)):
                if hit:
                    a, b = sorted((top(x), top(y)))
                    root[b] = a
            by_size[len(x)].append(x)
    seen, gone = set(), set()
    for i, n, x in places:
        if top(x) in seen:
            gone.add((i, n))
        seen.add(top(x))
    want = {i: t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}
    out = pipe.drop_repeated_lines(spark, docs, FOLDER)
    assert out.columns == docs.columns and gone
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_simhash_stage(spark, docs):
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(fps)
    value = np.array([fps[i] for i in ids], np.uint64)
    root = common.local_components(len(ids), *np.nonzero(np.bitwise_count(value[:, None] ^ value[None]) <= 4))
    out = pipe.drop_near_copies(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [ids[n] for n in sorted(set(root.tolist()))]


def test_mixing_stage(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    con.execute(f"create view labels as select * from read_parquet('{FOLDER}/labels.parquet')")
    want = Counter({i: taken // size for i, size, _, _, taken in con.execute(mixing.OP8_SQL).fetchall() if taken})
    out = pipe.mix_sources(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_mixing_tells_copies_of_an_id_apart(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f", "s"), (2, "g h", "t"), (None, "a b c", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = mixing.mix(mixing.with_quality(mixing.sized(df), labels)).collect()
    out = mixing.mixed_documents(df, labels).collect()
    assert len(out) == sum(r["times"] for r in plan)
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in plan)


def test_packing_stage(spark, docs):
    made = packing.encoder(packing.tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = made.whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], p, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], np.uint32).tobytes())] += 1
    got = pipe.pack(spark, docs, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == [0, *np.cumsum([n for _, n in rows])[:-1]] and sum(n for _, n in rows) <= 4096
    assert len(by) == -(-sum(n for rows in by.values() for _, n in rows) // 4096)  # no packing needs fewer


@pytest.mark.parametrize("size", [1 << 18, 50])
def test_language_scores(spark, docs, size, monkeypatch):
    model = langid.fit(docs)
    k = len(model.langs)
    monkeypatch.setattr(langid, "STRETCH", size)
    monkeypatch.setattr(common, "SLICE_BYTES", common.SLICE_BYTES if size > 50 else 1)
    for r in langid.label(docs, model).collect():
        index, offsets, vocabulary = common.words(pa.array([r["text"]], pa.string()))
        forms, first, number = langid.forms_of(vocabulary)
        at, ends = langid.spread(index, offsets, first, number)
        if not len(at):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        score = langid.emissions(forms, model)[at]
        forward, back = np.zeros((len(at), k)), np.zeros((len(at), k))  # in logarithms, a word at a time
        forward[0] = model.first + score[0]
        for t in range(1, len(at)):
            forward[t] = score[t] + np.logaddexp.reduce(forward[t - 1][:, None] + model.step, axis=0)
        for t in range(len(at) - 2, -1, -1):
            back[t] = np.logaddexp.reduce(model.step + (score[t + 1] + back[t + 1])[None], axis=1)
        p = np.exp(forward + back - np.logaddexp.reduce(forward[-1]))
        mass = p.sum(0)
        assert abs(mass.max() / len(at) - r["score"]) < 1e-4 and r["lang_pred"] == model.langs[mass.argmax()]
