"""Packing of token pieces into sequences by a configuration linear program (operator 9)."""

from __future__ import annotations

import codecs
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import free, saved, slices, table, words

CAPACITY, END_ID = 4096, 1
#: Classes of lengths that the program has at most, steepness of its weights, the gap at which it ends, and the most rounds.
CLASSES, EPS, GAP, ROUNDS = 256, 0.2, 0.005, 10_000
#: Pieces of one class that are numbered together.
GROUP = 20_000
CACHED = 300_000
#: A word of Latin letters and the signs (no apostrophe) behind it: each is one unit to the tokenizer.
PARTS = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"
_loaded: dict = {}


class Encoder:
    """Ids of whole texts by a tokenizer file. Words between white space are encoded once and kept, up to CACHED of them.

    Sound only for a tokenizer that drops white space and never joins across it; its file is checked for that. Words of
    Latin letters go to the model itself, all new ones at once, past the tokenizer's patterns; signs behind a word are
    encoded apart from it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        probe = "Aa bB  c\tdé\n\né, x."
        ids = [i for w in probe.split() for i in self.whole.encode(w, add_special_tokens=False).ids]
        if ids != self.whole.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path}: it does not encode word by word")
        self.known: dict[str, bytes] = {}
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.whole.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        # the bytes of Latin letters as the byte-level alphabet writes them: printable ones stay, others follow from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.bytes = "".join(chr(hidden.get(b, b)) if b > 127 else chr(b) for b in range(256))
        tried = ["the", "çà", "ñandú", "größe", "a", "zxqj"]
        self.direct = self.plain(tried) == [*map(self.slow, tried)] and self.slow("the,-") == self.slow("the") + self.slow(",-")

    def slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def plain(self, some: list[str]) -> list[bytes]:
        """Ids of words of small Latin letters, each of which is one unit to the model."""
        shown = codecs.charmap_decode("\n".join(some).encode(), "strict", self.bytes)[0]
        ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(some):
            return [*map(self.slow, some)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encoded(self, vocabulary: list[str]) -> list[bytes]:
        """Ids of each of the words. When too many are known, those stay that are met here."""
        known, column = self.known, pa.array(vocabulary, pa.string())
        letters, signs = pc.extract_regex(column, PARTS).flatten() if self.direct else (pa.nulls(len(column), pa.string()),) * 2
        whole = letters.is_null().to_numpy(zero_copy_only=False).tolist()
        heads = pc.coalesce(pc.utf8_lower(letters), column).to_numpy(zero_copy_only=False).tolist()
        tails = pc.fill_null(signs, "").to_numpy(zero_copy_only=False).tolist()
        if len(known) + len(heads) > CACHED:
            known = self.known = {w: known[w] for w in heads if w in known}
        new = [*{w for w, x in zip(heads, whole) if not x and w not in known}]
        if new:
            known.update(zip(new, self.plain(new)))
        known.update((w, self.slow(w)) for w in {*tails, *(w for w, x in zip(heads, whole) if x)} if w not in known)
        return [known[a] + known[b] if b else known[a] for a, b in zip(heads, tails)]

    def texts(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's followed by the id `end` if it is given; and where each text begins."""
        index, offsets, vocabulary = words(column)
        own = self.encoded(vocabulary)
        if end is not None:
            own.append(np.array([end], np.uint32).tobytes())
            index = np.insert(index, offsets[1:], len(vocabulary))
            offsets = offsets + np.arange(len(offsets))
        flat, size = np.frombuffer(b"".join(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own)) // 4
        first, n = np.cumsum(size) - size, size[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[index] - (ends - n), n) + np.arange(n.sum())]
        return ids, np.concatenate([[0], ends])[offsets]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and END_ID, cut where longer than the capacity.

    A null text is empty and has one piece, the end id. Only the last piece of a document may be shorter.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        made = encoder(path)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, begin = made.texts(part.column(text_col), END_ID)
                size = np.diff(begin)
                number = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                at = begin[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                more = [pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), ids.astype(np.int32))] * with_ids
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *more],
                    names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(each, schema)


def price(sizes: np.ndarray, value: np.ndarray, cells: int) -> tuple[np.ndarray, float]:
    """The configuration (how many of each size) of the most value that fits into `cells`, and its value.

    An unbounded knapsack's dynamic program; cells that no size reaches back into are worked out together. Sizes rise,
    and one that a smaller size is worth no less than is left out.
    """
    worth = np.flatnonzero(value > np.append(0.0, np.maximum.accumulate(value)[:-1]))
    every, sizes, value = len(sizes), sizes[worth], value[worth]
    best, pick = np.zeros(cells + 1), np.full(cells + 1, -1)
    step = int(sizes.min())
    for low in range(step, cells + 1, step):
        c = np.arange(low, min(low + step, cells + 1))
        back = c[:, None] - sizes
        gain = np.where(back >= 0, best[np.maximum(back, 0)] + value, -1.0)
        k = gain.argmax(1)
        pick[c], best[c] = k, gain[np.arange(len(c)), k]
        run = np.maximum.accumulate(np.append(best[low - 1], best[c]))[1:]  # room may stay empty
        pick[c], best[c] = np.where(run > best[c], -1, pick[c]), run
    chosen, c = np.zeros(every, np.int64), cells
    while c > 0:
        if pick[c] < 0 or best[c] <= best[c - 1]:
            c -= 1
        else:
            chosen[worth[pick[c]]] += 1
            c -= int(sizes[pick[c]])
    return chosen, float(best[cells])


def fractional(sizes: np.ndarray, need: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations and how often each is used (fractions) so that every size is covered, and a bound that no cover goes below.

    Multiplicative weights for the covering program (Plotkin, Shmoys and Tardos 1995; Fleischer 2000): a size's weight
    falls exponentially with the share of it covered so far; the configuration of most weight is used as often as its
    scarcest size allows. The dynamic program prices one only when none found before comes within EPS of the last
    optimum, which can but fall. Its weights are dual: their sum over the optimum bounds the program from below. It
    ends when bound and cover are within GAP, or after ROUNDS rounds with the cover there is.
    """
    weight, cover = np.ones(len(sizes)), np.zeros(len(sizes))
    pool, used, bound, top = np.zeros((0, len(sizes))), np.zeros(0), 0.0, 0.0
    for _ in range(ROUNDS):
        value = weight / need
        found = pool @ value
        k = int(found.argmax()) if len(found) else -1
        if k < 0 or found[k] < (1 - EPS) * top:
            chosen, top = price(sizes, value, cells)
            bound = max(bound, weight.sum() / top)
            k = next((i for i in np.flatnonzero(found >= top * (1 - 1e-12)) if (pool[i] == chosen).all()), -1)
            if k < 0:
                pool, used, k = np.vstack([pool, chosen]), np.append(used, 0.0), len(pool)
            if cover.min() > 0 and used.sum() / cover.min() <= bound * (1 + GAP):
                break
        row = pool[k]
        times = (need[row > 0] / row[row > 0]).min()
        used[k] += times
        cover += row * times / need
        weight *= np.exp(-EPS * row * times / need)
        if weight.max() < 1e-200:
            weight /= weight.max()
            top = 0.0
    return pool.astype(np.int64), used / max(cover.min(), 1e-12), bound


def rounded(pool: np.ndarray, used: np.ndarray, members: list[np.ndarray], left: np.ndarray, cells: int) -> list[tuple[dict[int, int], int]]:
    """Configurations of true lengths and how often each is used, by a fractional solution over classes; left: items of each length, which go down.

    Fractions are rounded down along their running sum, the most used first. A class is served by its commonest length,
    the last place by the longest length of any class that fits into the room. One that lacks items is not used further.
    """
    lengths, made, upto, done = np.sort(np.concatenate(members)), [], 0.0, 0
    for k in np.argsort(-used, kind="stable"):
        upto += used[k]
        quota, done = int(upto + 1e-9) - done, int(upto + 1e-9)
        parts = [g for g in np.flatnonzero(pool[k])[::-1] for _ in range(pool[k][g])]
        while quota:
            own, room = Counter(), cells
            for n, g in enumerate(parts):
                fit = members[g] if n + 1 < len(parts) else lengths
                fit = fit[:np.searchsorted(fit, room, side="right")]
                fit = fit[left[fit] > 0]
                if not len(fit):
                    break
                x = int(fit[-1] if n + 1 == len(parts) else fit[left[fit].argmax()])
                own[x] += 1
                left[x] -= 1
                room -= x
            for x, n in own.items():
                left[x] += n
            if own.total() < len(parts):
                break
            times = min(quota, *(int(left[x]) // n for x, n in own.items()))
            for x, n in own.items():
                left[x] -= n * times
            made.append((dict(own), times))
            quota -= times
    return made


def configurations(count: dict[int, int], cells: int, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> how many) and how often each is used, so that every counted item has its place.

    The configuration program over the histogram is solved by multiplicative weights (`fractional`), then rounded down
    and its configurations are filled with items: of each size class the commonest length, and last the longest length that
    fits into the room left. Histograms of more than CLASSES lengths are grouped for the program alone, by equal steps
    of length, a class counting with its mean; what is placed are true lengths. Lengths below a 64th of the capacity
    are no part of the program. What it leaves, which are those and the remainders of the rounding, goes best-fit,
    longest first. report, if given, gets the bound and the shares of items placed by the program.
    """
    left = np.zeros(cells + 1, np.int64)
    left[list(count)] = list(count.values())
    total, made, bound = sum(x * n for x, n in count.items()) / cells, [], 0.0
    while True:
        large = np.flatnonzero(left)
        large = large[large >= max(1, cells // 64)]
        before = left[large].sum()
        if not before:
            break
        step = 1 if len(large) <= CLASSES else -(-cells // CLASSES)
        _, group = np.unique((large - 1) // step, return_inverse=True)
        need = np.bincount(group, left[large])
        pool, used, low = fractional(np.rint(np.bincount(group, left[large] * large) / need).astype(np.int64), need, cells)
        if not made and step == 1 and len(large) == len(count):
            bound = low  # of the whole program, with true lengths
        made += rounded(pool, used, [large[group == g] for g in range(len(need))], left, cells)
        if left[large].sum() > before / 2:
            break
    if report is not None:
        report.update(bound=max(bound, total), placed=1 - left.sum() / max(1, sum(count.values())))
    rooms: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(cells + 1)]
    there = np.zeros(cells + 1, bool)

    def put(room: int, config: dict[int, int], times: int) -> None:
        rooms[room].append((config, times))
        there[room] = True

    for config, times in made:
        put(cells - sum(x * n for x, n in config.items()), config, times)
    for size in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[size])
        while rest:
            room = size + int(there[size:].argmax())
            if not there[room]:
                each = min(cells // size, rest)
                put(cells - size * each, {size: each}, rest // each)
                rest -= each * (rest // each)
                continue
            config, times = rooms[room].pop()
            there[room] = bool(rooms[room])
            filled = min(times, rest)
            if times > filled:
                put(room, config, times - filled)
            put(room - size, config | {size: config.get(size, 0) + 1}, filled)
            rest -= filled
    return [x for found in rooms for x in found]


def pack(items: DataFrame, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: no sequence is longer than the capacity, offsets have no gaps.

    items: rows with a length from 1 to the capacity; it should be cheap to read twice (a saved table). Only the
    histogram comes to the driver and only configurations over it go out, both of a size that the capacity bounds.
    Rows of equal `order` values are alike and may change places. Columns sequence_id and offset of items are replaced.
    """
    items = items.drop("sequence_id", "offset")
    kind, part, base, key, turn, number = free(items, "kind", "part", "base", "key", "slot", "number")
    rows = items.withColumn(kind, F.col(length_col).cast("int"))
    count = {r[kind]: r["count"] for r in rows.groupBy(kind).count().collect()}
    if not count:
        return items.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    # an interval: pieces of a class with numbers from lo on go to sequences from `first` on, `each` to a sequence
    taken, first, table_rows = Counter(), 0, []
    for config, times in configurations(count, capacity):
        for slot, (size, each) in enumerate(sorted(config.items(), reverse=True)):
            table_rows.append((size, taken[size], first, each, slot))
            taken[size] += each * times
        first += times
    spans = np.array(sorted(table_rows), np.int64)
    keys = spans[:, 0] << 40 | spans[:, 1]
    deal = max(1, -(-max(count.values()) // GROUP))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(deal)).cast("int"))
    parts = rows.groupBy(kind, part).agg(F.count("*").alias(number))
    before = F.sum(number).over(Window.partitionBy(kind).orderBy(part)) - F.col(number)
    rows = rows.join(parts.select(kind, part, before.alias(base)), [kind, part])
    place_in_class = F.row_number().over(Window.partitionBy(kind, part).orderBy(*order)) - 1 + F.col(base)
    rows = rows.withColumn(key, F.col(kind).cast("long") * F.lit(1 << 40) + place_in_class).drop(kind, part, base)
    names = items.columns

    def place(batches):
        for batch in batches:
            own = batch.column(key).to_numpy()
            at = np.searchsorted(keys, own, side="right") - 1
            rank = own - keys[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(spans[at, 2] + rank // spans[at, 3]), pa.array(spans[at, 4] * 8192 + rank % spans[at, 3])],
                names=[*names, "sequence_id", turn])

    schema = items.withColumns({"sequence_id": F.lit(0).cast("long"), turn: F.lit(0).cast("long")}).schema
    placed = rows.select(*names, key).mapInArrow(place, schema)
    upto = F.sum(length_col).over(Window.partitionBy("sequence_id").orderBy(turn))
    return placed.withColumn("offset", (upto - F.col(length_col)).cast("long")).drop(turn)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each. Null texts count as empty; an empty table gives no rows.
    """
    return pack(saved(pieces(docs, path or tokenizer_path(), capacity=capacity)), ["doc_id", "piece", "ids_crc32"], capacity=capacity)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
