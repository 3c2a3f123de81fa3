"""BPE encoding by a table of distinct words, and decoding by a join of ids with their pieces (operator 13)."""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from procuris.llm.common import at_exit, runs, shared_dir, slices, table, words

#: Bytes of text whose words are numbered together; a single longer text has a group of its own. Bytes of text for each
#: bucket of words, so that a bucket holds the words of some groups at most.
GROUP_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Words that the tokenizer takes at a time; ids whose pieces are put together at a time, besides a longer text's; the most buckets of groups that a table has.
WORDS_AT_ONCE, IDS_AT_ONCE, MOST_PARTS = 4096, 1 << 18, 100_000
#: How hard codes and words are squeezed, as they are written and shuffled.
LEVEL = 9
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding; loaded once in a process.

    Fit are tokenizers that part text at white space and drop it, and that write pieces as they are when decoding.
    Anything else raises ValueError.
    """
    if path not in _loaded:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        probe = "Aa bB  c\tdé\n\né, x."
        if [i for w in probe.split() for i in made.encode(w, add_special_tokens=False).ids] != made.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path}: it does not encode word by word")
        if made.decoder is not None:
            raise ValueError(f"{path}: it rewrites pieces when decoding")
        _loaded[path] = made
    return _loaded[path]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed planes of bytes: the higher ones are nearly all zero."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return squeezed(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(loosened(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def loosened(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def saved_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """df written to the shared folder and read again, its rows dealt into n files' worth of buckets by a hash of the column, so that a join on it need not shuffle them."""
    spark, name = df.sparkSession, f"procuris_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/procuris/{name}"
    df.write.bucketBy(n, column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    at_exit(spark, path)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and out knows them
    return out


def split(docs: DataFrame, text_col: str, buckets: int, parts: int) -> DataFrame:
    """Texts as numbers of words, saved in `parts` buckets of grp: rows (grp, row, n, codes) for texts, some in a row, and (grp, bucket, n, codes, words) for their words.

    Words are what ASCII white space parts, as they stand. A group is texts of about GROUP_BYTES of one task, and numbers its
    distinct words, the most frequent first, so that numbers pack well. A text row has the other columns of docs as a
    list of structs (row), the number of words of each text and the codes of all of them; a word row has the words of a
    group that fall into one bucket by their hash, by rising code.
    """
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = StructType([StructField("grp", LongType()), StructField("bucket", IntegerType()), StructField("row", ArrayType(base.schema["row"].dataType)),
                       StructField("n", BinaryType()), StructField("codes", BinaryType()), StructField("words", BinaryType())])

    def each(batches):
        group = TaskContext.get().partitionId() << 32
        known, size, held = {}, 0, []

        def done():
            if not held:
                return
            row_type = pa.list_(held[0][0].type)
            names = pa.array(list(known), pa.string())
            known.clear()
            count = np.zeros(len(names), np.int64)
            for _, _, codes in held:
                count += np.bincount(codes, minlength=len(names))
            order = pc.sort_indices(pa.table({"n": count, "w": names}), [("n", "descending"), ("w", "ascending")]).to_numpy()
            rank = np.empty(len(names), np.uint32)
            rank[order] = np.arange(len(names), dtype=np.uint32)
            for rows, n, codes in held:
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.nulls(1, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(row_type),
                                                  pa.array([packed(n)]), pa.array([packed(rank[codes])]), pa.nulls(1, pa.binary())], names=kind.names)
            names = names.take(pa.array(order)).cast(pa.binary())
            where = np.fromiter((crc32(w.as_py()) % buckets for w in names), np.int64, len(names))
            for bucket in np.unique(where).tolist():
                at = np.flatnonzero(where == bucket)
                words_of = b"\n".join(names.take(pa.array(at)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([bucket], pa.int32()), pa.nulls(1, row_type), pa.nulls(1, pa.binary()),
                                                  pa.array([packed(np.diff(at, prepend=0))]), pa.array([squeezed(words_of)])], names=kind.names)

        for batch in batches:
            for part in slices(batch, "text"):
                nbytes = part.column("text").nbytes
                if held and size + nbytes > GROUP_BYTES:
                    yield from done()
                    known, size, held, group = {}, 0, [], group + 1
                size += nbytes
                index, offsets, vocabulary = words(part.column("text"), lower=False)
                own = np.fromiter((known.setdefault(w, len(known)) for w in vocabulary), np.int64, len(vocabulary))
                held.append((part.column("row"), np.diff(offsets), own[index].astype(np.uint32) if len(vocabulary) else np.zeros(0, np.uint32)))
        yield from done()

    return saved_by(base.mapInArrow(each, kind), "grp", parts)


def encoded_words(parts: DataFrame, path: str) -> DataFrame:
    """(grp, codes, n, ids) of word rows: how many ids each word has, and all of them. The tokenizer sees each distinct word once.

    All rows of a bucket meet; a word is in one row for each group that has it, however frequent it is.
    """
    dealt = parts.filter(F.col("bucket").isNotNull()).select("bucket", "grp", "codes", "words").repartition("bucket").sortWithinPartitions("bucket")

    def each(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores
        made = tokenizer(path)
        for part in runs(batches, ["bucket"]):
            cuts = np.flatnonzero(np.diff(part["bucket"].to_numpy())) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
                lists = [loosened(x.as_py()).decode("utf-8", "surrogatepass").split("\n") for x in part["words"].slice(a, b - a)]
                distinct = list(dict.fromkeys(w for some in lists for w in some))
                found = {}
                for start in range(0, len(distinct), WORDS_AT_ONCE):
                    some = distinct[start:start + WORDS_AT_ONCE]
                    found.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(some, made.encode_batch_fast(some, add_special_tokens=False)))
                for some, grp, codes in zip(lists, part["grp"].slice(a, b - a), part["codes"].slice(a, b - a)):
                    ids = [found[w] for w in some]
                    n, flat = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([grp.as_py()]), pa.array([codes.as_py()]), pa.array([packed(n)]), pa.array([packed(flat)])], names=["grp", "codes", "n", "ids"])

    return dealt.mapInArrow(each, "grp long, codes binary, n binary, ids binary")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>) in place of the text.

    The ids are those of the tokenizer for the whole text without special tokens added; strings of special tokens in a
    text count as such. Every distinct word of the table is encoded once, and its ids are joined back to the numbered
    words of the texts. Null, empty and blank texts have no ids. Rows of equal id or text are rows of their own; other
    columns stay, but a column named ids is replaced; an empty table gives no rows.
    """
    docs = docs.drop("ids")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = split(docs, text_col, max(8, -(-size // BUCKET_BYTES)), min(MOST_PARTS, max(8, -(-size // GROUP_BYTES))))
    texts = parts.filter(F.col("bucket").isNull()).select("grp", "row", "n", "codes")
    row = parts.schema["row"].dataType.elementType

    def joined(words_of: pa.Table, texts_of: pa.Table) -> pa.Table:
        """The texts of one group with the ids of its words in the places of their codes."""
        code = [np.cumsum(unpacked(x.as_py()), dtype=np.int64) for x in words_of["codes"]]
        size = [unpacked(x.as_py()).astype(np.int64) for x in words_of["n"]]
        flat = np.concatenate([np.zeros(0, np.uint32), *(unpacked(x.as_py()) for x in words_of["ids"])]).astype(np.int32)
        code, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (code, size))
        lengths, first = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        lengths[code], first[code] = size, np.cumsum(size) - size
        out = []
        for rows, n, codes in zip(texts_of["row"], texts_of["n"], texts_of["codes"]):
            n, codes = unpacked(n.as_py()).astype(np.int64), unpacked(codes.as_py())
            own = lengths[codes]
            before = np.cumsum(own) - own
            ids = flat[np.repeat(first[codes] - before, own) + np.arange(own.sum())]
            upto = np.append(0, np.cumsum(own))[np.append(0, np.cumsum(n))]
            out.append(pa.table({"row": rows.values, "ids": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids))}))
        return pa.concat_tables(out) if out else pa.table({"row": pa.nulls(0, texts_of["row"].type.value_type), "ids": pa.nulls(0, pa.list_(pa.int32()))})

    kind = StructType([StructField("row", row), StructField("ids", ArrayType(IntegerType()))])
    done = encoded_words(parts, path).groupBy("grp").cogroup(texts.groupBy("grp")).applyInArrow(joined, kind)
    return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != text_col), "ids")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the ids joined with their pieces, a blank between. A column of that name is replaced.

    Ids that the vocabulary lacks are left out, as the tokenizer does; null or empty ids give an empty text. The table of
    pieces by id, of a size that the tokenizer file fixes, goes to every task, where ids meet it.
    """
    base = rows.drop(out_col)
    names, vocabulary = base.columns, tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    shared = base.sparkSession.sparkContext.broadcast(pieces)

    def each(batches):
        named = pa.array(shared.value, pa.string())
        there = named.is_valid().to_numpy(zero_copy_only=False)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(), dtype=np.int64)
            start = 0
            while start < batch.num_rows:  # some rows at a time: pieces take more room than ids
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + IDS_AT_ONCE, side="right")))
                part = batch.slice(start, stop - start)
                ids = pc.fill_null(part.column(ids_col).flatten(), -1).to_numpy()
                known = (ids >= 0) & (ids < len(there))
                known[known] = there[ids[known]]
                upto = np.append(0, np.cumsum(known))[np.append(0, ends[start:stop] - before)]
                found = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), named.take(pa.array(ids[known])))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(found, " ").cast(pa.string())], names=[*names, out_col])
                start = stop

    return base.mapInArrow(each, StructType([*base.schema.fields, StructField(out_col, StringType())]))


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    shown = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), shown.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
