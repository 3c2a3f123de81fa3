"""The operators' array code against brute force."""

import io
import itertools
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from procuris.llm import common, langid, linededup, packing, simhash, toxicity, warczip


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(n, seed=3, alphabet="abcé "):
    r, out = random.Random(seed), []
    for _ in range(n):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(20, 40)))
        t = list(s)
        for _ in range(r.randint(0, 4)):
            k, o = r.randrange(len(t) + 1), r.random()
            if o < 0.33:
                t.insert(k, r.choice(alphabet))
            elif k < len(t):
                t[k:k + 1] = [] if o < 0.66 else [r.choice(alphabet)]
        out.append((s, "".join(t)))
    return out


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    a, b = zip(*variants(400))
    assert linededup.edits_within(list(a), list(b), tau).tolist() == [edits(x, y) <= tau for x, y in zip(a, b)]


def test_long_lines_are_trimmed(monkeypatch):
    monkeypatch.setattr(linededup, "LONG", 10)
    a, b = zip(*variants(400), ("x" * 50, "x" * 52), ("ab" * 500, "ab" * 500), ("a" + "xy" * 900 + "b", "c" + "xy" * 900 + "d"))
    assert linededup.edits_within(list(a), list(b), 2).tolist() == [edits(x, y) <= 2 for x, y in zip(a, b)]


@pytest.mark.parametrize("hot", [None, 3, 10])
def test_runs(hot):
    r = np.random.default_rng(7)
    keys = np.sort(r.integers(0, 12, 100))
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["key", "v"]) for k, v in zip(np.array_split(keys, 9), np.array_split(np.arange(100), 9))]
    got, rows = {}, set()
    for part in common.runs(batches, ["key"], hot):
        for k in set(part["key"].to_pylist()):
            got.setdefault(k, []).append(bool(part.schema.metadata))
        rows.update(part["v"].to_pylist())
        assert not part.schema.metadata or len(set(part["key"].to_pylist())) == 1
    assert rows == set(range(100)) and all(len(x) == 1 or all(x) for x in got.values())


def test_segments_miss_no_pair():
    lines = sorted({x for pair in variants(250) for x in pair if len(x) >= 20})
    keys = {}
    for key, at, sign in linededup.segment_rows(lines, 2, 20):
        for k, i, s in zip(key.tolist(), at.tolist(), sign.tolist()):
            keys.setdefault(k, []).append((i, s))
    found = set()
    for rows in keys.values():
        for (i, s), (j, t) in itertools.product(rows, rows):
            if i != j and linededup.alike(np.array([s], np.int32), np.array([t], np.int32), 2)[0]:
                found.add((i, j))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if abs(len(lines[i]) - len(lines[j])) <= 2 and edits(lines[i], lines[j]) <= 2:
            assert (i, j) in found or (j, i) in found


def test_sliced_pairs_are_all_pairs():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 700, dtype=np.uint64)
    b = a.copy()
    for i in range(0, 700, 2):
        for bit in r.choice(64, i % 7, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    first, stop = np.sort(r.integers(0, 700, (2, 700)), axis=0)
    for lo, hi in ((np.zeros(700, int), np.full(700, 700)), (first, stop), (first, first)):
        got = sorted((int(i), int(j)) for x, y in simhash.sliced_pairs(a, b, lo, hi, 4, step=50) for i, j in zip(x, y))
        want = np.argwhere(np.bitwise_count(a[:, None] ^ b[None]) <= 4)
        assert got == sorted((i, j) for i, j in want.tolist() if lo[i] <= j < hi[i])


def test_simhash_edges():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a B")
    assert simhash.fingerprint("one two three") != 0


def test_forward_backward():
    r = np.random.default_rng(0)
    score, step, first = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    got = langid.marginals(score, np.array([0, 5, 5, 9]), step, first)
    for begin, end in ((0, 5), (5, 9)):
        want, z = np.zeros((end - begin, 3)), 0.0
        for y in itertools.product(range(3), repeat=end - begin):
            w = np.exp(first[y[0]] + score[range(begin, end), y].sum() + sum(step[p, q] for p, q in zip(y, y[1:])))
            z += w
            want[range(end - begin), y] += w
        assert np.allclose(want / z, got[begin:end])


def test_long_chain_is_the_whole_one():
    r = np.random.default_rng(6)
    rows, step, first = r.normal(size=(20, 3)).astype(np.float32), r.normal(size=(3, 3)), r.normal(size=3)
    at = r.integers(0, 20, 101)
    want = langid.marginals(rows[at].astype(np.float64), np.array([0, 101]), step, first)
    for size in (1, 7, 101, 500):
        got = np.concatenate(list(langid.long_chain(rows, at, step, first, size))[::-1])
        assert np.allclose(got, want)


def test_language_model_learns_two_alphabets():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice(abc) for _ in range(5)) for _ in range(30)) for abc in ("abcd", "wxyz") for _ in range(20)]
    field = langid.fit_texts(texts, ["one"] * 20 + ["two"] * 20)
    forms, first, number = langid.forms_of(["abca", "zzwx", "..."])
    p = langid.marginals(langid.emissions(forms, field), np.array([0, 2]), field.step, field.first)
    assert p.argmax(1).tolist() == [0, 1] and number.tolist() == [1, 1, 0]
    assert langid.fit_texts([], []).langs == []


def test_configurations_place_every_item():
    r = random.Random(4)
    for _ in range(5):
        count = {r.randint(1, 64): r.randint(1, 50) for _ in range(20)}
        made, placed = packing.configurations(count, 64), {}
        for config, times in made:
            assert sum(x * n for x, n in config.items()) <= 64
            for x, n in config.items():
                placed[x] = placed.get(x, 0) + n * times
        assert placed == count
        rooms = []
        for x in sorted((x for x, n in count.items() for _ in range(n)), reverse=True):  # best fit, longest first
            fits = [i for i, room in enumerate(rooms) if room >= x]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= x
            else:
                rooms.append(64 - x)
        assert sum(t for _, t in made) <= len(rooms) + 1


@pytest.mark.parametrize("n", [1, 50])
def test_configuration_program_beats_best_fit(n):
    report = {}
    made = packing.configurations({2070: 6 * n, 1090: 6 * n, 1055: 6 * n, 945: 12 * n}, 4096, report)  # best fit: 11 n
    assert sum(t for _, t in made) == 9 * n and report["placed"] == 1 and report["bound"] <= 9 * n


def test_configuration_program_places_most_of_a_wide_histogram():
    r, report = np.random.default_rng(1), {}
    lengths, number = np.unique(r.integers(700, 1901, 20000), return_counts=True)
    made = packing.configurations(dict(zip(lengths.tolist(), number.tolist())), 4096, report)
    assert report["placed"] > 0.9 and sum(t for _, t in made) <= 1.005 * report["bound"]  # best fit: 1.05


def test_price_is_the_best_configuration():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes, cells = np.unique(r.integers(3, 40, 6)), 60
        value = r.random(len(sizes)) * sizes
        chosen, best = packing.price(sizes, value, cells)
        every = [np.array(x) for x in itertools.product(*(range(cells // s + 1) for s in sizes)) if np.dot(x, sizes) <= cells]
        assert abs(max(x @ value for x in every) - best) < 1e-9 and abs(chosen @ value - best) < 1e-9 and chosen @ sizes <= cells


def test_encoder_is_the_tokenizer():
    made = packing.encoder(packing.tokenizer_path())
    texts = ["The QUICK, brown\tfox's 12 jumps!", "", "çà ñandú größe é İ x y", "a" * 300, "你好  \n", "don't---stop", "Éèpa.&&& ÉÈ!?", "ŁÓDŹ... e\u0301a", "'s it's,'s 3.14% (x) \\ a_b ```"]
    for end in (None, 1):
        ids, at = made.texts(pa.array(texts), end)
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == made.whole.encode(text, add_special_tokens=False).ids + [1] * (end is not None)


def test_ftrl_separates():
    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "bb", "cc"]) for _ in range(20)) + (" bad" if i % 3 == 0 else "") for i in range(300)]
    row, cell = toxicity.features(*common.words(pa.array(texts)))
    ends = np.searchsorted(row[np.argsort(row, kind="stable")], np.arange(301))
    cell = cell[np.argsort(row, kind="stable")]
    rows = [(np.unique(cell[ends[i]:ends[i + 1]]), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit_rows(rows)
    weights = dict(zip(model.index.tolist(), model.value.tolist()))
    score = [sum(weights.get(int(c), 0) for c in at) + model.bias for at, _ in rows]
    assert all((s > 0) == bool(y) for s, (_, y) in zip(score, rows))
    assert toxicity.fit_rows([]).bias is None


@pytest.mark.parametrize("wide", [False, True])
def test_package_round_trip(wide):
    out = io.BytesIO()
    package = warczip.Package(out, force64=wide)
    data = warczip.record("response", "http://x/\r\n", "urn:page:1", b"abc", 3, "a9993e364706816aba3e25717850c26c9cd0d89d", None)
    package.add("archive/d.warc", data)
    package.add("indexes/d.cdx", b"xy")
    package.close()
    raw = out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(raw)).read("archive/d.warc") == data

    class Source:
        def read_at(self, n, at):
            return raw[at:at + n]

    found = {name: raw[at:at + size] for name, at, size in warczip.members(Source(), len(raw))}
    assert found == {"archive/d.warc": data, "indexes/d.cdx": b"xy"}
    assert warczip.read_record(data)["bytes"] == 3
    with pytest.raises(ValueError):
        warczip.read_record(data.replace(b"abc", b"abd"))


def test_words_slices_and_components():
    texts = pa.array([" a  B\x0bc ", None, "", "é É"])
    index, offsets, vocabulary = common.words(texts)
    assert [[vocabulary[i] for i in index[a:b]] for a, b in zip(offsets, offsets[1:])] == [["a", "b", "c"], [], [], ["é", "É"]]
    assert common.local_components(5, np.array([1, 3]), np.array([2, 4])).tolist() == [0, 1, 1, 3, 3]
