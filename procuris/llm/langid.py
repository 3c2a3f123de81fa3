"""Language of words and texts by a linear-chain conditional random field (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from procuris.llm.common import crc32_of_id, slices, table, words

BITS = 16
#: About so many labelled texts of each language (a sample by hash of the id) fit the model.
SAMPLE = 300
#: Longer words are read as several of so many letters.
LONGEST = 32
#: Words of each language in the lexicon, and training steps of so many word sequences.
LEXICON, STEPS, SEQUENCES, SPAN = 400, 150, 96, 24
CACHED = 400_000
#: Words of a single long text whose messages are held at once.
STRETCH = 1 << 18
UNKNOWN = "und"


@dataclass
class Field:
    """The learned chain: languages, weights of hashed features by language, lexicon, transition scores."""

    langs: list[str]
    weight: np.ndarray
    lexicon: dict[str, int]
    step: np.ndarray
    first: np.ndarray


def letters(word: str) -> str:
    """The word without what is no letter at its ends; inner signs stay. Empty if it has no letter."""
    if word.isalpha():
        return word.lower()
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0]:at[-1] + 1].lower() if at else ""


def cells(forms: list[str]) -> np.ndarray:
    """Hashed features of each form of at most LONGEST letters: n-grams of 1 to 4 with edges, the affixes of 1 to 3, the form.

    0 stands for no feature; how many columns there are depends on the longest form.
    """
    size = np.fromiter(map(len, forms), np.int64, len(forms))
    most = int(size.max())
    wide = np.array(forms, f"U{most}").view(np.uint32).reshape(len(forms), most).astype(np.uint64)
    edged = np.zeros((len(forms), most + 2), np.uint64)
    edged[:, 1:-1] = wide
    edged[:, 0] = 1
    rows = np.arange(len(forms))
    edged[rows, size + 1] = 2
    prime = np.uint64(0x100000001B3)

    def slot(h):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - BITS)).astype(np.int32) | 1

    out = []
    for n in range(1, min(4, most + 2) + 1):
        h = np.full((len(forms), most + 3 - n), np.uint64(n))
        for k in range(n):
            h = h * prime + edged[:, k:most + 3 - n + k]
        out.append(np.where(np.arange(h.shape[1])[None] + n <= size[:, None] + 2, slot(h), 0))
    for n in range(1, min(3, most) + 1):
        head, tail = np.full(len(forms), np.uint64(16 + n)), np.full(len(forms), np.uint64(32 + n))
        for k in range(n):
            head = head * prime + wide[:, k]
            tail = tail * prime + wide[rows, np.maximum(size - n + k, 0)]
        fits = size >= n
        out += [np.where(fits, slot(head), 0)[:, None], np.where(fits, slot(tail), 0)[:, None]]
    whole = np.full(len(forms), np.uint64(64))
    for k in range(most):
        whole = np.where(k < size, whole * prime + wide[:, k], whole)
    out.append(slot(whole)[:, None])
    return np.concatenate(out, axis=1)


def emissions(forms: list[str], field: Field) -> np.ndarray:
    """Scores of every language for each form: the sum over its features, and the lexicon's."""
    k = len(field.langs)
    out = np.zeros((len(forms), k))
    order = sorted(range(len(forms)), key=lambda i: len(forms[i]))
    for start in range(0, len(order), 2048):
        part = order[start:start + 2048]
        at = cells([forms[i] for i in part])
        got = np.where(at[:, :, None] > 0, field.weight[at], 0)
        out[part] = got.sum(1, dtype=np.float64)
    listed = [(i, field.lexicon[f]) for i, f in enumerate(forms) if f in field.lexicon]
    if listed:
        row, lang = np.array(listed).T
        out[row, lang] += field.weight[0, lang]
    return out


def marginals(score: np.ndarray, offsets: np.ndarray, step: np.ndarray, first: np.ndarray, sides: bool = False):
    """Forward-backward over every sequence at once: the chance of each language at each word.

    score: words x languages, the sequences one after another; offsets: where each begins, and the end. sides: also
    the scaled forward message and the word's own score times the backward message, for chances of pairs.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    begin = np.concatenate([[0], np.cumsum(active)])  # words are laid out step by step, longest sequence first
    total = int(begin[-1])
    place = np.empty(total, np.int64)
    for n in range(len(size)):
        place[start[n]:start[n] + size[n]] = begin[:size[n]] + n
    k = score.shape[1]
    bloom = np.empty((total, k))
    bloom[place] = np.exp(score - score.max(1, keepdims=True)) if total else score
    t_step, t_first = np.exp(step - step.max()), np.exp(first - first.max())
    back_step, unit = np.ascontiguousarray(t_step.T), np.ones((k, k))
    forward, out = np.empty((total, k)), np.empty((total, k))
    after = np.empty((total, k)) if sides else None
    for t in range(longest):
        now = forward[begin[t]:begin[t + 1]]
        if t:
            np.matmul(forward[begin[t - 1]:begin[t - 1] + active[t]], t_step, out=now)
        else:
            now[:] = t_first
        now *= bloom[begin[t]:begin[t + 1]]
        now /= now @ unit
    back = np.ones((0, k))
    for t in range(longest - 1, -1, -1):
        span, grown = slice(begin[t], begin[t + 1]), np.ones((active[t], k))
        grown[:len(back)] = back
        both = np.multiply(forward[span], grown, out=out[span])
        both /= both @ unit
        grown *= bloom[span]
        if sides:
            after[span] = grown
        back = grown @ back_step
        back /= back @ unit
    return (out[place], forward[place], after[place]) if sides else out[place]


def stretch(score: np.ndarray, before: np.ndarray | None, after: np.ndarray, step: np.ndarray, first: np.ndarray):
    """Marginals of a stretch of one sequence, by the forward message that enters it (None: it begins) and the backward one
    that comes from behind it; and the messages that leave it on either side."""
    bloom, t_step = np.exp(score - score.max(1, keepdims=True)), np.exp(step - step.max())
    forward, out = np.empty_like(bloom), np.empty_like(bloom)
    now = before
    for t in range(len(bloom)):
        now = (np.exp(first - first.max()) if now is None else now @ t_step) * bloom[t]
        now = forward[t] = now / now.sum()
    for t in range(len(bloom) - 1, -1, -1):
        both = forward[t] * after
        out[t] = both / both.sum()
        after = t_step @ (after * bloom[t])
        after /= after.sum()
    return out, now, after


def long_chain(rows: np.ndarray, at: np.ndarray, step: np.ndarray, first: np.ndarray, size: int):
    """Yields the marginals of one sequence (forms `at` of rows), a stretch of `size` words at a time, from the last to the first.

    The forward messages between stretches are kept from a pass of their own, so that only one stretch is in memory.
    """
    begins = range(0, len(at), size)
    heads, now = [], None
    for s in begins:
        heads.append(now)
        now = stretch(rows[at[s:s + size]].astype(np.float64), now, np.ones(rows.shape[1]), step, first)[1]
    after = np.ones(rows.shape[1])
    for s, before in zip(reversed(begins), reversed(heads)):
        p, _, after = stretch(rows[at[s:s + size]].astype(np.float64), before, after, step, first)
        yield p


def forms_of(vocabulary: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each distinct word its forms (pieces of LONGEST letters), as (forms, first form, number); 0 where no letter is."""
    forms, first, number = [], np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for i, w in enumerate(vocabulary):
        plain = letters(w)
        first[i] = len(forms)
        if plain:
            forms += [plain[k:k + LONGEST] for k in range(0, len(plain), LONGEST)]
            number[i] = len(forms) - first[i]
    return forms, first, number


def spread(index: np.ndarray, offsets: np.ndarray, first: np.ndarray, number: np.ndarray):
    """Words of texts as forms: (form of each place, offsets by text)."""
    many = number[index]
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[index] - ends[:-1], many) + np.arange(ends[-1])
    return at, ends[offsets]


def fit_texts(texts: list[str], langs: list[str]) -> Field:
    """Learn the chain by AdaGrad on the conditional likelihood.

    A text's label stands for its words. Half of the sequences are two spans of texts of different languages joined,
    so that the transitions learn what a switch costs.
    """
    names = sorted(set(langs))
    k = len(names)
    field = Field(names, np.zeros((1 << BITS, k)), {}, np.zeros((k, k)), np.zeros(k))
    index, offsets, vocabulary = words(pa.array(texts, pa.string()))
    forms, first, number = forms_of(vocabulary)
    if k < 2 or not forms:
        return field
    at, offsets = spread(index, offsets, first, number)
    tag = np.array([names.index(x) for x in langs])
    owner = np.repeat(tag, np.diff(offsets))
    count = np.stack([np.bincount(at[owner == j], minlength=len(forms)) for j in range(k)])
    best = count.argmax(0)
    for j in range(k):
        own = np.flatnonzero((best == j) & (count[j] > 1))
        for f in own[np.argsort(-count[j][own], kind="stable")][:LEXICON]:
            field.lexicon[forms[f]] = j
    feature = cells(forms)
    listed = np.array([field.lexicon.get(f, -1) for f in forms])
    usable = [np.flatnonzero((tag == j) & (np.diff(offsets) > 0)) for j in range(k)]
    alive = [j for j in range(k) if len(usable[j])]
    if len(alive) < 2:
        return field
    rng = np.random.default_rng(11)
    sums = [np.full_like(x, 1e-3) for x in (field.weight, field.step, field.first)]

    def span(lang, length):
        text = rng.choice(usable[lang])
        begin = offsets[text] + rng.integers(0, max(1, offsets[text + 1] - offsets[text] - length + 1))
        return np.arange(begin, min(begin + length, offsets[text + 1]))

    for _ in range(STEPS):
        places, truth, ends = [], [], [0]
        for n in range(SEQUENCES):
            one = rng.choice(alive)
            parts = [(one, span(one, SPAN))]
            if n % 2:
                other = rng.choice([j for j in alive if j != one])
                cut = int(rng.integers(2, SPAN - 1))
                parts = [(one, parts[0][1][:cut]), (other, span(other, SPAN - cut))]
            for lang, x in parts:
                places.append(at[x])
                truth.append(np.full(len(x), lang))
            ends.append(ends[-1] + sum(len(x) for _, x in parts))
        place, gold, ends = np.concatenate(places), np.concatenate(truth), np.array(ends)
        unique, inverse = np.unique(place, return_inverse=True)
        score = np.zeros((len(unique), k))
        own = feature[unique]
        for column in range(own.shape[1]):
            score += np.where(own[:, column, None] > 0, field.weight[own[:, column]], 0)
        hit = listed[unique]
        score[hit >= 0, hit[hit >= 0]] += field.weight[0, hit[hit >= 0]]
        score = score[inverse]
        p, before, after = marginals(score, ends, field.step, field.first, sides=True)
        miss = p.copy()
        miss[np.arange(len(gold)), gold] -= 1
        grad = np.zeros_like(field.weight)
        by_form = np.stack([np.bincount(inverse, miss[:, j], len(unique)) for j in range(k)], 1)
        for j in range(k):
            grad[:, j] = np.bincount(own.ravel(), np.repeat(by_form[:, j], own.shape[1]), 1 << BITS)
            grad[0, j] = by_form[hit == j, j].sum()
        inner = np.ones(len(gold), bool)
        inner[ends[:-1]] = False
        right = np.flatnonzero(inner)
        joint = before[right - 1][:, :, None] * after[right][:, None, :] * np.exp(field.step - field.step.max())[None]
        pair = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        np.subtract.at(pair, (gold[right - 1], gold[right]), 1)
        start = p[ends[:-1]].sum(0) - np.bincount(gold[ends[:-1]], minlength=k)
        for x, g, total, l2 in ((field.weight, grad, sums[0], 1e-4), (field.step, pair, sums[1], 1e-3), (field.first, start, sums[2], 1e-3)):
            g = g / SEQUENCES + l2 * x
            total += g * g
            x -= 0.2 * g / np.sqrt(total)
    field.weight[:] = field.weight.astype(np.float32)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Field:
    """The chain learned from rows with a language; of each about `sample` at most are used, chosen by a hash of id and text.

    The sample goes through one task, and the weights (a fixed number for each language) come back. Null languages
    and texts are left out; no language at all gives a model that knows none.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).agg(F.count("*").alias("_n"))
    own = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("langid"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), own.alias("_o"))
    sizes = sizes.withColumnRenamed(lang_col, "lang")
    chosen = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("_o", F.lit(1 << 20)) / float(1 << 20) < sample / F.col("_n"))
    chosen = chosen.select("lang", "text", "_o").dropDuplicates(["_o", "lang"])  # a row that is repeated without end is learned once
    one = chosen.repartition(1).sortWithinPartitions("_o", "lang", "text")

    def train(batches):
        texts, langs = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            langs += batch.column("lang").to_pylist()
        got = fit_texts(texts, langs)
        live = np.flatnonzero(got.weight.any(1))
        yield pa.RecordBatch.from_arrays([
            pa.array([got.langs], pa.list_(pa.string())), pa.array([live.tolist()], pa.list_(pa.int32())),
            pa.array([got.weight[live].ravel().tolist()], pa.list_(pa.float64())),
            pa.array([list(got.lexicon)], pa.list_(pa.string())), pa.array([list(got.lexicon.values())], pa.list_(pa.int32())),
            pa.array([got.step.ravel().tolist()], pa.list_(pa.float64())), pa.array([got.first.tolist()], pa.list_(pa.float64()))],
            names=["langs", "at", "weight", "word", "lang", "step", "first"])

    got = one.mapInArrow(train, "langs array<string>, at array<int>, weight array<double>, word array<string>, lang array<int>, step array<double>, first array<double>").first()
    k = len(got["langs"]) if got else 0
    weight = np.zeros((1 << BITS, k), np.float32)
    if not k:
        return Field([], weight, {}, np.zeros((0, 0)), np.zeros(0))
    weight[got["at"]] = np.array(got["weight"], np.float32).reshape(-1, k)
    return Field(list(got["langs"]), weight, dict(zip(got["word"], got["lang"])), np.array(got["step"]).reshape(k, k), np.array(got["first"]))


def label(docs: DataFrame, model: Field, text_col: str = "text", by_word: bool = False) -> DataFrame:
    """docs with lang_pred and score: the language with most of its words' marginal mass, and its mean marginal.

    The words of the whole text are one chain. A null text, or one without a letter, gets "und" and 0, as does every
    text if no language was learned. by_word adds word_langs, the likeliest language of each word with a letter (a word
    beyond LONGEST letters has one for each piece). Columns of docs with these names are replaced.
    """
    extra = ["lang_pred", "score"] + ["word_langs"] * by_word
    base = docs.drop(*extra)
    names = base.columns
    shared = base.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        field = shared.value
        k, known, rows, used = len(field.langs), {}, np.zeros((CACHED, len(field.langs)), np.float32), 0
        choice = np.array([*field.langs, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, text_col):
                index, offsets, vocabulary = words(part.column(text_col))
                n = part.num_rows
                best, score, tags = np.full(n, k), np.zeros(n), [[]] * n
                if k and vocabulary:
                    new = [w for w in vocabulary if w not in known]
                    forms, first, number = forms_of(new)
                    if used + len(forms) > CACHED or len(known) > 2 * CACHED:
                        known, used, new = {}, 0, vocabulary
                        forms, first, number = forms_of(new)
                        rows = np.zeros((max(CACHED, len(forms)), k), np.float32)
                    rows[used:used + len(forms)] = emissions(forms, field)
                    known.update(zip(new, ((first + used) << 24 | number).tolist()))
                    used += len(forms)
                    own = np.fromiter(map(known.__getitem__, vocabulary), np.int64, len(vocabulary))
                    at, ends = spread(index, offsets, own >> 24, own & ((1 << 24) - 1))
                    size = np.diff(ends)
                    full = np.flatnonzero(size)
                    if n == 1 and len(at) > STRETCH:
                        mass, tagged = np.zeros((1, k)), []
                        for p in long_chain(rows, at, field.step, field.first, STRETCH):
                            mass += p.sum(0)
                            tagged.append(p.argmax(1).astype(np.int16))
                        tagged = np.concatenate(tagged[::-1])
                    else:
                        p = marginals(rows[at].astype(np.float64), ends, field.step, field.first)
                        mass = np.add.reduceat(p, ends[:-1][full], axis=0) if len(full) else np.zeros((0, k))
                        tagged = p.argmax(1) if by_word else None
                    best[full] = mass.argmax(1)
                    score[full] = np.clip(mass.max(1) / size[full], 0, 1)
                    if by_word:
                        likely = choice[tagged]
                        tags = [likely[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
                more = [pa.array(choice[best].tolist(), pa.string()), pa.array(score)]
                more += [pa.array(tags, pa.list_(pa.string()))] * by_word
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, *extra])

    kinds = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    kinds += [StructField("word_langs", ArrayType(StringType()))] * by_word
    return base.mapInArrow(each, StructType([*base.schema.fields, *kinds]))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(crc32_of_id(), F.lit(5)) == 0
    model = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return label(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
