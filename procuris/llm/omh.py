"""Order MinHash fingerprints of texts with DataFrame functions alone (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procuris.llm.common import saved, table

#: Words of a k-mer, and tuples of a signature.
K, TUPLES = 3, 32
#: Documents that one bucket of neighbours holds, about.
BUCKET_ROWS = 1000
#: Bytes of text that one task signs, about.
TASK_BYTES = 4 << 20
#: Ranges that one level of quantiles parts ids into at most, and buckets that one window over bucket numbers holds.
RANGES, FAN = 128, 1024
#: Low bits of a packed long that hold the place in the text (a string of Spark has under 2^31 bytes, so under 2^30
#: words); the high ones hold the hash.
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1


def kmers(texts: DataFrame, keys: list[str], text_col: str, k: int = K) -> DataFrame:
    """keys with kmers: hashes of the k-mers of words (parted by ASCII white space) in text order.

    A text of fewer than k words has one k-mer, all its words; one without a word has none.
    """
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tokens = texts.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    hashed, size = F.col("_h"), F.size("_h")
    joined = F.transform(hashed, lambda h, i: F.xxhash64(h, *(F.get(hashed, i + j) for j in range(1, k))))
    return tokens.select(*keys, F.slice(joined, 1, F.least(size, F.greatest(F.lit(1), size - (k - 1)))).alias("kmers"))


def signatures(texts: DataFrame, keys: list[str], text_col: str, carried: Column, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """keys with signature (an array of `tuples` ints) and carried for every row of texts; keys name a row.

    Order MinHash (Marcais et al. 2019) with tuples of two. Each k-mer gets the number of its occurrence in the text.
    For each of the orders (hashes of k-mer, number and tuple) the smallest element and, in the reversed order, again
    the smallest are picked: two elements as likely to be any pair as the two smallest are, found with min and max.
    They stay in text order and are hashed together. No k-mer at all gives a signature of zeros.

    keys have to include the columns that texts is partitioned by, then nothing is shuffled here. carried goes along
    with the first k-mer only.
    """
    grams = kmers(texts.withColumn("_c", carried), [*keys, "_c"], text_col, k)
    # sorted packed longs hand the rows on nearly as the window below wants them
    packed = F.sort_array(F.transform("kmers", lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))
    rows = grams.select(*keys, "_c", F.posexplode_outer(packed).alias("_n", "_p"))
    rows = rows.select(*keys, F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_c")).alias("_c"),
                       F.shiftright("_p", PLACE_BITS).alias("_g"), F.col("_p").bitwiseAND(F.lit(PLACE)).alias("_at"))
    number = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("_at"))
    rows = rows.select(*keys, "_c", "_at", F.when(F.col("_g").isNotNull(), F.xxhash64("_g", number)).alias("_e"))
    rows = rows.select(*keys, "_c", *(F.when(F.col("_e").isNotNull(), F.shiftleft(F.shiftright(F.xxhash64("_e", F.lit(n)), PLACE_BITS), PLACE_BITS).bitwiseOR(F.col("_at"))).alias(f"_r{n}") for n in range(tuples)))
    ends = rows.groupBy(*keys).agg(F.max("_c").alias("carried"), *(f(f"_r{n}").alias(f"{name}{n}") for n in range(tuples) for name, f in (("lo", F.min), ("hi", F.max))))

    def pair(n: int) -> Column:
        lo, hi = F.col(f"lo{n}"), F.col(f"hi{n}")
        first = lo.bitwiseAND(F.lit(PLACE)) <= hi.bitwiseAND(F.lit(PLACE))
        a, b = F.shiftright(lo, PLACE_BITS), F.shiftright(hi, PLACE_BITS)
        return F.when(lo.isNull(), F.lit(0)).otherwise(F.when(first, F.hash(a, b)).otherwise(F.hash(b, a)))

    return ends.select(*keys, "carried", F.array(*(pair(n) for n in range(tuples))).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """The share of tuples that two signatures have in common, place by place."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def printed(signature: str) -> Column:
    """A signature as text: 8 hex digits for each tuple."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def bucketed(docs: DataFrame, id_col: str, text_col: str = "text", rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """docs with bucket, a number that rises with the id, for about `rows` documents each; and how many there are.

    Quantiles part the ids into ranges, quantiles of each range part it once more, and where that is too coarse still,
    even steps part what lies between two of them. Null ids are in the first bucket. An id of more rows is parted by the hash of its texts.
    """
    n = docs.count()
    parts = max(1, -(-n // rows))
    first = min(parts, RANGES)
    second = min(-(-parts // first), RANGES)
    steps = -(-parts // (first * second))

    def quantiles(k: int) -> Column:
        return F.array_sort(F.array_distinct(F.percentile_approx(id_col, [i / k for i in range(k + 1)], 10000))).cast("array<long>")

    def place(lows: Column) -> Column:
        return F.greatest(F.lit(0), F.size(F.filter(lows, lambda c: c <= F.col(id_col))) - 1)

    def literal(values: list[int]) -> str:
        return "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "-9223372036854775807L" for v in values) + ")"

    one = docs.agg(quantiles(first)).first()[0] or [0]
    docs = docs.withColumn("_one", place(F.expr(literal(one))))
    found = {r["_one"]: r["lows"] for r in docs.groupBy("_one").agg(quantiles(second).alias("lows")).collect()} if n else {}  # a row for each range
    lows = F.get(F.expr("array(" + ", ".join(literal(found.get(i) or [0]) for i in range(len(one))) + ")"), F.col("_one"))
    docs = docs.withColumn("_two", place(lows))
    low = F.get(lows, F.col("_two"))
    high = F.coalesce(F.get(lows, F.col("_two") + 1), low + 1)
    step = F.floor((F.col(id_col) - low).cast("double") / (high - low).cast("double") * steps)
    step = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.coalesce(step, F.lit(0))))
    bucket = (F.col("_one").cast("long") * (second + 1) + F.col("_two")) * steps + step
    # never null, by type too: a filter for it would keep the shuffles of texts apart that are one
    docs = docs.withColumn("bucket", F.coalesce(bucket.cast("long"), F.lit(0).cast("long"))).drop("_one", "_two")
    return split_hot(docs, id_col, text_col, rows), parts


def split_hot(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """docs whose buckets (see bucketed) are parted further where one id, or null, has over `rows` rows: by ranges of the hash of the text.

    Buckets still rise with id and hash. Nothing changes where no id is so frequent.
    """
    hot = docs.groupBy("bucket", id_col).count().filter(F.col("count") > rows)
    if hot.isEmpty():
        return docs
    hot = saved(hot)
    most, width = hot.agg(F.max("count")).first()[0], hot.groupBy("bucket").count().agg(F.max("count")).first()[0]
    splits, regions = -(-most // rows), 2 * width + 2
    found = hot.groupBy("bucket").agg(F.array_sort(F.collect_list(id_col)).alias("_ids"), F.max(F.col(id_col).isNull()).alias("_null"))
    docs = docs.join(found, "bucket", "left")
    own, ids = F.col(id_col), F.coalesce("_ids", F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>"))
    # region 0: null; then ids below the first hot one, the first hot one, ids up to the second and so on
    upto = F.size(F.filter(ids, lambda x: x <= own))
    is_hot = F.coalesce(F.array_contains(ids, own), own.isNull() & F.col("_null"), F.lit(False))
    region = F.when(own.isNull(), 0).otherwise(1 + 2 * upto - F.array_contains(ids, own).cast("int"))
    share = (F.xxhash64(text_col).cast("double") / 2.0**64 + 0.5) * splits
    sub = F.when(is_hot, F.least(F.lit(splits - 1), F.greatest(F.lit(0), F.floor(share)))).otherwise(0)
    number = (F.col("bucket") * regions + region) * splits + sub
    return docs.withColumn("bucket", F.coalesce(number.cast("long"), F.lit(0).cast("long"))).drop("_ids", "_null")


def following_heads(heads: DataFrame) -> DataFrame:
    """(bucket, _follow) of heads (bucket, _first): the first of the next bucket, of the first one after the last.

    Windows run over FAN bucket numbers, and over one row for each FAN of them.
    """
    up = heads.withColumn("_up", F.coalesce(F.floor(F.col("bucket") / FAN), F.lit(0).cast("long")))
    tops = up.groupBy("_up").agg(F.min_by(F.struct("_first"), "bucket").alias("_top"))
    order = Window.orderBy("_up")
    after = F.coalesce(F.lead("_top").over(order), F.first("_top").over(order))
    tops = tops.select("_up", after.alias("_after"))
    lead = F.lead(F.struct("_first")).over(Window.partitionBy("_up").orderBy("bucket"))
    return up.join(tops, "_up").select("bucket", F.coalesce(lead, F.col("_after"))["_first"].alias("_follow"))


def with_next(rows: DataFrame, order: list[str], payload: str, out: str) -> DataFrame:
    """rows (with bucket) with `out`, the payload of the next row by `order` (of the first one after the last), and `no`, the row's number in its bucket.

    Inside a bucket it is a window; the last row of each bucket meets the first of the next bucket by a join.
    """
    inner = Window.partitionBy("bucket").orderBy(*order)
    heads = following_heads(rows.groupBy("bucket").agg(F.min_by(payload, F.struct(*order)).alias("_first")))
    marked = rows.withColumns({"_next": F.lead(F.struct(F.col(payload).alias("v"))).over(inner), "no": F.row_number().over(inner)})
    return marked.join(heads, "bucket", "left").withColumn(out, F.when(F.col("_next").isNotNull(), F.col("_next.v")).otherwise(F.col("_follow"))).drop("_next", "_follow")


def edited(text: str, following: str) -> Column:
    """text with its last quarter of code points replaced by as many (or all) of the start of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - cut), F.substring(F.col(following), F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    A null text is empty. One document is its own next one. Every row counts by itself: rows of one id, or of none,
    have a row each and follow each other by the hash of their texts, null ids first. Texts that are equal have equal
    fingerprints; an empty table gives no rows. Columns that docs has besides are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, _ = bucketed(plain, "doc_id")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartition(max(1, -(-size // TASK_BYTES)), "bucket").withColumn("_hash", F.xxhash64("text"))
    rows = with_next(rows, ["doc_id", "_hash"], "text", "following")
    rows = rows.select("bucket", "no", "doc_id", "text", edited("text", "following").alias("changed"))
    both = rows.select("bucket", "no", "doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("changed").alias("text")))).alias("x"))
    fact = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
    signed = signatures(both.select("bucket", "no", "doc_id", "x.*"), ["bucket", "no", "kind"], "text", fact)

    def of(kind: int, what: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(what)))

    own = saved(signed.groupBy("bucket", "no").agg(of(0, "carried.doc_id").alias("doc_id"), of(0, "signature").alias("own"), of(1, "signature").alias("changed"),
                                                   of(0, "carried.n_chars").alias("n_chars"), of(1, "carried.sha256").alias("edited_sha256")))
    own = with_next(own, ["no"], "own", "following")
    return own.select("doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("changed").alias("edited_fingerprint"),
                      likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))


def op3(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
