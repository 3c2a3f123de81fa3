"""Finding many names in many texts: an Aho-Corasick automaton in every task, in shards when names are many."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procuris.sources.shared import saved

#: Letters of the names that one automaton holds, about; texts are walked once for each shard of so many.
SHARD_LETTERS = 4_000_000
_built: dict = {}


def _automaton(name: str, forms: list[str]):
    """The automaton of a shard, built once in a process; the one before is let go."""
    if name not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for form in forms:
            made.add_word(form, form)
        made.make_automaton()
        _built.clear()
        _built[name] = made
    return _built[name]


def occurrences(texts: DataFrame, patterns: DataFrame, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(text_id, pattern_id) for each of patterns (pattern_id, pattern) that stands anywhere in one of texts (text_id, text), case aside.

    Distinct patterns are dealt into shards of about shard_letters letters by a hash. A shard is all that the driver and
    a task hold at a time; a text is walked once a shard, in time of its length and hits, whatever the number of
    names. Ids come back by a join on the pattern, so one that many ids share costs no more to find. Null and empty
    texts and patterns match nothing; repeated rows and ids give a row for each pair of ids once.
    """
    found, named = _walked(texts, patterns, shard_letters, counted=False)
    return found.join(named, "form").select("text_id", "pattern_id").distinct()


def _walked(texts: DataFrame, patterns: DataFrame, shard_letters: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """(text_id, form) of each row's own forms, or if counted (form, n) of a task's rows; and (pattern_id, form)."""
    spark = texts.sparkSession
    named = patterns.select("pattern_id", F.lower("pattern").alias("form")).filter("form <> ''")
    forms = saved(named.select("form").distinct())
    letters = forms.agg(F.sum(F.length("form"))).first()[0] or 0
    shards = max(1, -(-letters // shard_letters))
    forms = forms.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)))
    low = texts.select("text_id", F.lower("text").alias("text"))
    kind = "form string, n long" if counted else f"text_id {texts.schema['text_id'].dataType.simpleString()}, form string"

    def walked(n: int) -> DataFrame:
        shared = spark.sparkContext.broadcast([r["form"] for r in forms.filter(F.col("shard") == n).select("form").collect()])
        name = f"{spark.sparkContext.applicationId}-{shared.id if hasattr(shared, 'id') else id(shared)}-{n}-{hash(tuple(shared.value))}"

        def each(batches):
            found = shared.value
            machine = _automaton(name, found) if found else None
            if counted:
                sums: Counter = Counter()
                for batch in batches:
                    for text in batch.column("text").to_pylist() if machine is not None else []:
                        if text:
                            sums.update({form for _, form in machine.iter(text)})
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array(sums.values(), pa.int64())], names=["form", "n"])
                return
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column("text").to_pylist() if machine is not None else []):
                    if text:
                        own = {form for _, form in machine.iter(text)}
                        rows.extend([i] * len(own))
                        hits.extend(own)
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["text_id", "form"])

        return low.mapInArrow(each, kind)

    found = walked(0)
    for n in range(1, shards):
        found = found.union(walked(n))
    return found, named


def mentions(texts: DataFrame, patterns: DataFrame, unique: bool = False, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(pattern_id, texts): of how many text_ids each pattern has an occurrence, as the rows of occurrences() would be counted.

    Texts are counted in their tasks, so that a form's counts go through the shuffle and not a row for each text and form.
    Texts of one id, and patterns of one id with several forms, have to meet as pairs; unique says that there are none.
    """
    named = patterns.select("pattern_id", F.lower("pattern").alias("form")).filter("form <> ''").distinct()
    if unique:
        found, named = _walked(texts, named.withColumnRenamed("form", "pattern"), shard_letters, counted=True)
        return found.groupBy("form").agg(F.sum("n").alias("texts")).join(named, "form").select("pattern_id", "texts")
    again = saved(texts.groupBy(F.col("text_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"))
    several = saved(named.groupBy(F.col("pattern_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"))
    met = lambda df, c, other, how: df.join(other, F.col(c).eqNullSafe(F.col("_id")), how)
    named = named.withColumnRenamed("form", "pattern")
    single, one_form = met(texts, "text_id", again, "left_anti"), met(named, "pattern_id", several, "left_anti")
    out, pairs = mentions(single, one_form, True, shard_letters), []
    if not several.isEmpty():
        pairs.append(occurrences(single, met(named, "pattern_id", several, "left_semi"), shard_letters))
    if not again.isEmpty():
        pairs.append(occurrences(met(texts, "text_id", again, "left_semi"), named, shard_letters))
    for found in pairs:
        out = out.union(found.groupBy("pattern_id").agg(F.count("*").alias("texts")))
    return out.groupBy("pattern_id").agg(F.sum("texts").alias("texts")) if pairs else out
