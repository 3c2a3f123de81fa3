"""Near-duplicate lines by a segment-partition edit join (operator 2)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.llm.common import blocked_pairs, components, free, local_components, runs, saved, slices, table, told_apart

#: Lines link at so many edits or fewer; only lines of LEAST code points on are compared so, shorter ones by equality.
TAU, LEAST = 2, 20
#: Rows of one segment from which the segment is parted into pairs of blocks.
HOT = 4096
#: Bits of the filter that spares lines without a candidate the shuffle of texts.
FILTER_BITS = 1 << 26
PRIME = 0x9E3779B97F4A7C15
#: Bits of a sign: the line looks here for others; others find it here.
PROBES, INDEXED = 1, 1 << 29
#: Cells of padded code points that one verification step holds; pairs of longer lines lose what they begin and end with alike.
STEP_CELLS, LONG = 2 << 20, 1000
#: Line hashes that a task remembers, so that it hands on the segments of a line that recurs once.
SEEN = 1 << 20
#: Classes of over a thousandth of all lines, of which there are under a thousand, go to every task from this size on.
COMMON = 10_000


def line_hash(line: str) -> int:
    """What names a line: XXH64 of seed 42 of its UTF-8, signed, as the engine's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def segments(length: np.ndarray, parts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Starts and lengths of the nearly equal parts of strings of these lengths; the longer parts come last."""
    base, more = length // parts, length % parts
    starts = [i * base + np.maximum(0, i - (parts - more)) for i in range(parts)]
    sizes = [base + (i >= parts - more) for i in range(parts)]
    return starts, sizes


def segment_rows(lines: list[str], tau: int, least: int):
    """(key, line, sign) of distinct lines: index keys (sign has INDEXED) of a line's own tau + 1 segments, and probe keys (sign has PROBES).

    A probe key stands for a substring that a line shorter by 0 to tau may have as its segment: those starts only that
    leave enough edits on both sides (multi-match-aware selection, Li et al. 2011). A line's own segments are index and
    probe keys at once. sign also holds counts of code points in 7 classes, modulo 16, above its lowest bit.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size) - size
    inside = np.arange(len(code)) - np.repeat(begin, size)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), np.uint64(PRIME))))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), np.uint64(pow(PRIME, -1, 1 << 64)))))
    total = np.append(np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[inside]))
    name = np.repeat(np.arange(len(lines)), size)
    count = np.bincount(name * 7 + code % 7, minlength=7 * len(lines)).reshape(-1, 7) & 15
    sign = (count << (4 * np.arange(7) + 1)).sum(1).astype(np.int32)

    def key(rows, start, length, whole, part):
        at = begin[rows] + start
        h = mixed((total[at + length] - total[at]) * inverse[start])
        return mixed(h + whole.astype(np.uint64) * np.uint64(2 * tau + 3) + np.uint64(part)).view(np.int64)

    for less in range(tau + 1):
        rows = np.flatnonzero(size - less >= least)
        whole = size[rows] - less
        starts, sizes = segments(whole, tau + 1)
        for i in range(tau + 1):
            for move in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
                start = starts[i] + move
                fits = (start >= 0) & (start + sizes[i] <= size[rows])
                yield key(rows[fits], start[fits], sizes[i][fits], whole[fits], i), rows[fits], sign[rows[fits]] | (PROBES if less or move else PROBES | INDEXED)


def alike(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """False where the class counts of two signs differ by more than tau edits can make; and where neither probes the other's index key."""
    apart = np.zeros(len(a), np.int32)
    for n in range(7):
        d = ((a >> (4 * n + 1)) - (b >> (4 * n + 1))) & 15
        apart += np.minimum(d, 16 - d)
    return (apart <= 2 * tau) & (((a & b >> 29) | (b & a >> 29)) & PROBES == PROBES)


def edits_within(a: list[str], b: list[str], tau: int) -> np.ndarray:
    """True where the edit distance of a[i] and b[i] (each of more than tau code points) is tau or less.

    Hyyro's (2003) banded bit-parallel algorithm: the 2 tau + 1 diagonals are the top bits of a word, a word for each pair,
    and all pairs of a step go on together, a code point at a time.
    """
    out = np.zeros(len(a), bool)
    a, b = zip(*(trimmed(x, y) if min(len(x), len(y)) > LONG else (x, y) for x, y in zip(a, b))) if len(a) else (a, b)
    one, two = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    order = np.argsort(np.maximum(one, two), kind="stable")
    order = order[np.abs(one - two)[order] <= tau]
    at = 0
    while at < len(order):
        rows = order[at:at + max(1, STEP_CELLS // int(max(one[order[at]], two[order[at]]) + 1))]
        most = int(np.maximum(one[rows], two[rows]).max())
        rows = rows[:max(1, STEP_CELLS // (most + 1))]
        most = int(np.maximum(one[rows], two[rows]).max())
        out[rows] = _banded([a[i] for i in rows], [b[i] for i in rows], one[rows], two[rows], tau) <= tau
        at += len(rows)
    return out


def trimmed(a: str, b: str, margin: int = 8) -> tuple[str, str]:
    """Two long lines without most of the beginning and end that they share, which leaves their distance as it is."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    begin = int(apart[0]) if len(apart) else n
    apart = np.flatnonzero(x[len(x) - n + begin:][::-1] != y[len(y) - n + begin:][::-1])
    end = int(apart[0]) if len(apart) else n - begin
    begin, end = max(0, begin - margin), max(0, end - margin)
    return a[begin:len(a) - end], b[begin:len(b) - end]


def _coded(lines: list[str], size: np.ndarray, before: int, after: int, fill: int) -> np.ndarray:
    """Code points with lines as columns, `fill` before and after each."""
    wide = np.full((len(lines), before + int(size.max()) + after), fill, np.uint32)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lines)), size)
    wide[row, before + np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = code
    return np.ascontiguousarray(wide.T)


def _banded(a, b, one, two, tau):
    shape = len(a)
    left = _coded(a, one, tau, int(two.max()) + tau + 1, 0xFFFFFFFF)
    right = _coded(b, two, 0, 1, 0xFFFFFFFE)
    top, band = np.uint64(63), [np.uint64(63 - 2 * tau + k) for k in range(2 * tau + 1)]
    vp = np.full(shape, np.uint64(((1 << (tau + 1)) - 1) << (63 - tau)))
    vn, dist = np.zeros(shape, np.uint64), np.full(shape, tau, np.int64)
    turn, unit = one - tau, np.uint64(1)
    for i in range(int(two.max())):
        x = np.zeros(shape, np.uint64)
        for k, bit in enumerate(band):
            x |= (left[i + k] == right[i]).astype(np.uint64) << bit
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        down = i < turn
        late = np.clip(62 - (i - turn), 0, 63).astype(np.uint64)
        change = np.where(down, 1 - (d0 >> top).astype(np.int64), ((hp >> late) & unit).astype(np.int64) - ((hn >> late) & unit).astype(np.int64))
        dist += np.where(i < two, change, 0)
        shifted = d0 >> unit
        vp, vn = hn | ~(shifted | hp), shifted & hp
    return dist


def counts(lines: list[str]) -> np.ndarray:
    """How many code points of each of 61 classes every line has."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.repeat(np.arange(len(lines)), size) * 61 + code % 61, minlength=61 * len(lines)).reshape(-1, 61).astype(np.int32)


def distinct_lines(texts: list, least: int) -> dict[str, int]:
    """The lines of at least `least` code points of some texts, with their hashes."""
    found = {x for t in texts if t for x in t.split("\n") if len(x) >= least}
    return {x: line_hash(x) for x in found}


def candidate_sets(rows: DataFrame, keys: list[str], tau: int, hot: int | None) -> DataFrame:
    """(gid, line, sign): sets of lines that rows of one key connect as candidates; a set has one gid wherever it is found.

    rows: key, line, sign, sorted by keys in every partition. With hot, a key of more rows comes back as it is, its gid
    the key and its sign not null.
    """
    names = [*keys, "line", "sign"] + ["blk"] * (len(keys) > 1)

    def join(batches):
        for part in runs(batches, keys, hot):
            cols = [part[k].to_numpy() for k in keys]
            line, sign = part["line"].to_numpy(), part["sign"].to_numpy()
            new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
            group = np.cumsum(new) - 1
            begin = np.append(np.flatnonzero(new), len(line))
            size = np.diff(begin)
            out, links = [], []
            small = np.flatnonzero((size[group] > 1) & (size[group] <= 48))
            for d in range(1, 48):
                i, j = small[:-d], small[d:]
                same = group[i] == group[j]
                if not same.any():
                    break
                i, j = i[same], j[same]
                hit = (line[i] == line[j]) | alike(sign[i], sign[j], tau)
                links.append((i[hit], j[hit]))
            for g in np.flatnonzero(size > (0 if hot and part.schema.metadata else 48)):
                at = np.arange(begin[g], begin[g + 1])
                if hot and (len(at) > hot or part.schema.metadata):
                    out.append((cols[0][at], line[at], pa.array(sign[at])))
                    continue
                # the rows left to reach shrink as a frontier goes on
                rest, front = at[1:], [at[0]]
                while len(rest):
                    if not front:
                        front, rest = [rest[0]], rest[1:]
                        continue
                    p = front.pop()
                    hit = (line[rest] == line[p]) | alike(np.broadcast_to(sign[p], len(rest)), sign[rest], tau)
                    links.append((np.full(int(hit.sum()), p), rest[hit]))
                    front.extend(rest[hit].tolist())
                    rest = rest[~hit]
            if any(len(i) for i, _ in links):
                nodes, inverse = np.unique(np.concatenate([*(i for i, _ in links), *(j for _, j in links)]), return_inverse=True)
                half = len(inverse) // 2
                root, member = local_components(len(nodes), inverse[:half], inverse[half:]), line[nodes]
                order = np.lexsort((member, root))
                root, member = root[order], member[order]
                fresh = np.concatenate([[True], (root[1:] != root[:-1]) | (member[1:] != member[:-1])])  # distinct lines of each set
                root, member = root[fresh], member[fresh]
                first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
                many = np.diff(np.append(first, len(root)))
                keep = np.repeat(many > 1, many)
                if keep.any():
                    gid = np.repeat(np.add.reduceat(mixed(member.view(np.uint64)), first).view(np.int64), many)
                    out.append((gid[keep], member[keep], pa.nulls(int(keep.sum()), pa.int32())))
            for g, m, s in out:
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(m), s], names=["gid", "line", "sign"])

    return rows.select(*names).mapInArrow(join, "gid long, line long, sign int")


def verified_links(rows: DataFrame, tau: int) -> DataFrame:
    """(a, b): stars that connect the lines of each group (gid, bi, bj; line, text) that true links connect."""

    def verify(batches):
        for part in runs(batches, ["gid", "bi", "bj"]):
            gid, bi, bj = (part[c].to_numpy() for c in ("gid", "bi", "bj"))
            line, text = part["line"].to_numpy(), part["text"].to_pylist()
            new = np.concatenate([[True], (gid[1:] != gid[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            begin = np.append(np.flatnonzero(new), len(line))
            a, b, i, j = [], [], [], []
            for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
                if e - s <= 6:
                    for x in range(s, e):
                        for y in range(x + 1, e):
                            i.append(x)
                            j.append(y)
                    continue
                rest, front, count = np.arange(s + 1, e), [s], counts(text[s:e])
                while len(rest):
                    if not front:
                        front, rest = [int(rest[0])], rest[1:]
                        continue
                    p = front.pop()
                    # an edit changes two counts by one at most, so few lines are left to verify
                    hit = np.abs(count[rest - s] - count[p - s]).sum(1) <= 2 * tau
                    near = np.flatnonzero(hit)
                    hit[near] = edits_within([text[p]] * len(near), [text[x] for x in rest[near]], tau)
                    a.extend([p] * int(hit.sum()))
                    b.extend(rest[hit].tolist())
                    front.extend(rest[hit].tolist())
                    rest = rest[~hit]
            if i:
                hit = np.flatnonzero(edits_within([text[x] for x in i], [text[x] for x in j], tau))
                a.extend(np.array(i)[hit].tolist())
                b.extend(np.array(j)[hit].tolist())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(line[a]), pa.array(line[b])], names=["a", "b"])

    return rows.select("gid", "bi", "bj", "line", "text").mapInArrow(verify, "a long, b long")


def bitmap(wanted: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, with those set that the low bits of wanted lines' hashes name; the same few MB for any table."""
    low = F.col("line").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # the bitmap functions count from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(low).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for n, bits in rows:
        out[(n - 1) * 4096:n * 4096] = np.frombuffer(bits, np.uint8)
    return out


def near_lines(docs: DataFrame, text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(node, root): for every line (by hash) that links with another the smallest hash it reaches."""

    def index(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, text_col):
                lines = {x: h for x, h in distinct_lines(part.column(text_col).to_pylist(), least).items() if h not in seen}
                if not lines:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(lines.values())
                name = np.fromiter(lines.values(), np.int64, len(lines))
                rows: dict = defaultdict(list)
                for key, at, sign in segment_rows(list(lines), tau, least):
                    rows["key"].append(key)
                    rows["line"].append(name[at])
                    rows["sign"].append(sign)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows[c])) for c in ("key", "line", "sign")], names=["key", "line", "sign"])

    texts = docs.select(text_col)
    keyed = texts.mapInArrow(index, "key long, line long, sign int")
    found = saved(candidate_sets(keyed.repartition("key").sortWithinPartitions("key"), ["key"], tau, HOT))
    # segments of very many lines: their rows are parted anew into pairs of blocks
    hot = found.filter("sign is not null").select(F.col("gid").alias("key"), "line", "sign").distinct()
    hot = blocked_pairs(hot, "key", F.col("line"), HOT // 2).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    sets = found.filter("sign is null").select("gid", "line").union(candidate_sets(hot, ["key", "bi", "bj"], tau, None).select("gid", "line"))
    sets = saved(sets.distinct())

    wanted = sets.select("line").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def spell(batches):
        marked = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                lines = distinct_lines(part.column(text_col).to_pylist(), least)
                name = np.fromiter(lines.values(), np.int64, len(lines))
                at = name.view(np.uint64) & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero(marked[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                spelling = list(lines)
                yield pa.RecordBatch.from_arrays([pa.array(name[hit]), pa.array([spelling[i] for i in hit], pa.string())], names=["line", "text"])

    # the bitmap keeps most other lines out of the shuffle, the join keeps the rest out
    spelled = texts.mapInArrow(spell, "line long, text string").join(wanted, "line", "left_semi").dropDuplicates(["line"])
    groups = blocked_pairs(sets.join(spelled, "line"), "gid", F.col("line"), HOT // 2)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: not to be coalesced
    groups = groups.repartition(parts, "gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj", "line")
    return components(verified_links(groups, tau))


def places(rows: DataFrame, who: list[str], text_col: str, tau: int, least: int) -> DataFrame:
    """(w0.., at, class): places of lines that an earlier line equals or nearly equals; class names the line's class.

    who: columns that name a row (see common.told_apart), as w0 and so on in the result, and order rows.
    """
    own = [f"w{i}" for i in range(len(who))]
    lines = rows.select(*(F.col(c).alias(w) for c, w in zip(who, own)), F.posexplode(F.split(text_col, "\n")).alias("at", "_line")).filter(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    lines = lines.select(*own, "at", F.xxhash64("_line").alias("_h"), F.length("_line").alias("_n"))
    roots = near_lines(rows, text_col, tau, least)
    # a class is a hash and a length; lengths of linked lines differ, so theirs is 0
    lines = saved(lines.join(roots, lines["_h"] == roots["node"], "left").select(
        *own, "at", F.coalesce("root", "_h").alias("class"), F.when(F.col("root").isNull(), F.col("_n")).otherwise(0).alias("_n")))
    place = F.struct(*own, "at")
    first = lines.groupBy("class", "_n").agg(F.min(place).alias("_first"), F.count("*").alias("_many")).filter("_many > 1")
    common = first.filter(F.col("_many") > max(COMMON, lines.count() // 1000)).drop("_many")  # under a thousand rows
    marked = lines.join(F.broadcast(common), ["class", "_n"], "left")
    other = marked.filter("_first IS NULL").drop("_first").join(first.drop("_many"), ["class", "_n"])
    return marked.filter(place != F.col("_first")).select(*own, "at", "class").union(other.filter(place != F.col("_first")).select(*own, "at", "class"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(id, key, copy, at, class): places of lines that an earlier line equals or nearly equals; class names the line's class.

    Lines are parted by line feeds; a line without a word (spaces alone) is none. Two lines are of one class if they
    are equal, or if links of tau edits or fewer connect them (both of at least `least` code points). Of a class the line
    of the smallest id (null first), then of the first place, is no repeat. Lines are told apart by 64-bit hashes and lengths.
    Where ids repeat, rows of one id are told apart by a hash of their texts (key) and follow each other by it; of rows
    alike in both one has copy 0, and every line of the others, which have copy 1, is a repeat. Elsewhere both are 0.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, who = told_apart(plain, "id", "text", "key", "copy")
    found = places(rows, who, "text", tau, least).distinct()
    more = ["w1", "w2"] if len(who) > 1 else [F.lit(0).cast("long"), F.lit(0)]
    return found.select("w0", *more, "at", "class").toDF(id_col, "key", "copy", "at", "class")


def with_repeats(docs: DataFrame, id_col: str, text_col: str, tau: int, least: int, lost: str) -> DataFrame:
    """docs with a column lost: the places of each row's repeated lines, null if it has none."""
    key, copy = free(docs, "key", "copy")
    rows, who = told_apart(docs, id_col, text_col, key, copy)
    own = [f"w{i}" for i in range(len(who))]
    gone = places(rows.select(*dict.fromkeys([*who, text_col])), who, text_col, tau, least).groupBy(*own).agg(F.collect_set("at").alias("_gone"))
    same = [rows[c].eqNullSafe(gone[w]) for c, w in zip(who, own)]
    return rows.join(gone, same, "left").select(*(rows[c] for c in docs.columns), gone["_gone"].alias(lost))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """docs with repeated lines cut out of text_col; columns and rows stay, a text of repeats alone is left empty.

    A null text stays null. Rows of one id, or of none, are cut each by its own lines; of repeated rows all but one are left empty.
    """
    names = docs.columns
    (lost_col,) = free(docs, "gone")
    joined = with_repeats(docs, id_col, text_col, tau, least, lost_col)
    place = names.index(text_col)

    def cut(batches):
        for batch in batches:
            out = []
            for text, lost in zip(batch.column(text_col).to_pylist(), batch.column(lost_col).to_pylist()):
                if text and lost:
                    lost = set(lost)
                    text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
                out.append(text)
            cols = [batch.column(n) for n in names]
            cols[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, docs.schema)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_repeated, repeated): for every document its lines with a word, and the places of repeats, rising."""
    whole = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = with_repeats(docs.select("doc_id", "text"), "doc_id", "text", TAU, LEAST, "gone")
    repeated = F.coalesce(F.array_sort("gone"), F.array().cast("array<int>"))
    return found.select("doc_id", F.size(whole).cast("long").alias("n_lines"), F.size(repeated).cast("long").alias("n_repeated"), repeated.alias("repeated"))


def op2(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
