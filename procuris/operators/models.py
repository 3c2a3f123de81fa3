"""Models of risk, segments and texts with Spark ML."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, Bucketizer, Normalizer, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from procuris.functions.columns import mapped
from procuris.operators.quantiles import exact_quantiles
from procuris.operators.relational import running, with_totals
from procuris.sources.shared import discard, saved

#: The label is cut from this score, so a model that sees it learns little else.
LEAKY = "composite_risk_score"

#: Values of a figure from which on it is cut into bins, and bins: as many as a forest looks at. Rows that a forest's draws tell apart.
FEW_VALUES, BINS, DRAWN = 100, 32, 500_000


def imputed(rows: DataFrame, features: list[str], fitted_to: DataFrame | None = None) -> DataFrame:
    """M1: exact medians for missing values, as doubles; 0 where a column has no value. Medians are those of rows, or of fitted_to.

    Only figures that rows has nulls of ask for a median, which takes several passes; one pass tells which.
    """
    gaps = rows.agg(*(F.coalesce(F.bool_or(F.col(f).cast("double").isNull()), F.lit(False)).alias(f) for f in features)).first()
    middle = exact_quantiles(rows if fitted_to is None else fitted_to, {f: [0.5] for f in features if gaps[f]}) if any(gaps) else {}
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(middle[f][0]), F.lit(0.0)) if f in middle else F.col(f).cast("double") for f in features})


def stratified_split(rows: DataFrame, key: str, label: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """M1: train and test with nearly the same share of each label, by a hash of key and label; always the same for the same keys."""
    share = F.pmod(F.xxhash64(key, label), F.lit(1 << 20)) / float(1 << 20)
    return rows.filter(share >= test), rows.filter(share < test)


def balanced(rows: DataFrame, label: str, times: str | None = None) -> DataFrame:
    """M1: rows with weight, the whole over the number of labels times the label's size; times: the column of how many rows a row stands for."""
    n = F.lit(1.0) if times is None else F.col(times)
    sizes = rows.groupBy(label).agg(F.sum(n).alias("_n"))
    sizes = with_totals(sizes, _all=F.sum("_n"), _k=F.count("*"))
    return rows.join(F.broadcast(sizes), label).withColumn("weight", n * F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def binned(rows: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """rows with figures of more than FEW_VALUES values as numbers of bins of about equal size, as a forest cuts them; the order of values stays.

    A forest of Spark ML sees no more than 32 bins of a figure, so it finds the same kind of splits, while rows of the same bins are alike.
    """
    many = rows.agg(*(F.approx_count_distinct(f).alias(f) for f in features)).first()
    wide = [f for f in features if many[f] > FEW_VALUES]
    if not wide:
        return rows
    cuts = rows.approxQuantile(wide, [i / bins for i in range(1, bins)], 0.001)
    splits = [[-math.inf, *sorted({c for c in own if math.isfinite(c)}), math.inf] for own in cuts]
    cut = Bucketizer(splitsArray=splits, inputCols=wide, outputCols=[f"_bin_{f}" for f in wide], handleInvalid="keep").transform(rows)
    return cut.withColumns({f: F.col(f"_bin_{f}") for f in wide}).drop(*(f"_bin_{f}" for f in wide))


def spread(rows: DataFrame, n: int) -> DataFrame:
    """n rows over as many tasks as there are cores, or as they warrant: small tables are read and joined by one task, which would then fit alone."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // 200_000))


def condensed(rows: DataFrame, features: list[str], label: str, drawn: int = DRAWN) -> DataFrame:
    """(features, label, rows): rows alike in features and label as few, with how many rows each stands for; saved, over all cores.

    Up to `drawn` rows every one is left to itself, so that a forest's draws with replacement fall on rows. Of more, alike
    ones are dealt into about so many parts of even size, two at least: each row keeps its weight, and the draws are those of a table of that size.
    Rows that are all different stay as they are.
    """
    cells = saved(rows.groupBy(*features, label).agg(F.count("*").alias("_n")))
    n = cells.agg(F.sum("_n")).first()[0] or 0
    parts = F.least(F.col("_n"), F.greatest(F.lit(2), F.ceil(F.col("_n") * (drawn / max(n, 1))))).cast("int")
    dealt = cells.withColumn("_parts", parts).withColumn("rows", F.col("_n") / F.col("_parts"))
    dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    return saved(spread(dealt.select(*features, label, "rows"), min(n, max(drawn, 1))), cells)


def classifier(kind: str, features: list[str], label: str, trees: int = 200, rounds: int = 200, seed: int = 42, times: str | None = None) -> Pipeline:
    """M1, M2: a random forest ("forest") or boosted trees for each label against the rest ("boosted"), with the label's index.

    Boosted trees have `rounds` of depth 6 and step 0.05; the labels' trees are grown side by side, from rows that each
    stand for `times` rows, if that column is named.
    """
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    vector = VectorAssembler(inputCols=features, outputCol="features")
    if kind == "forest":
        model = RandomForestClassifier(numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=seed, weightCol="weight")
    else:
        model = OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.05, seed=seed), parallelism=4, **({} if times is None else {"weightCol": times}))
    return Pipeline(stages=[index, vector, model])


def metrics(scored: DataFrame, times: str | None = None) -> dict[str, float]:
    """M3: accuracy and weighted F1; times: the column of how many rows a row stands for."""
    weighed = {} if times is None else {"weightCol": times}
    return {m: MulticlassClassificationEvaluator(metricName=m, **weighed).evaluate(scored) for m in ("accuracy", "f1")}


def cross_validated(rows: DataFrame, features: list[str], label: str, key: str = "vendor_id", kinds: tuple[str, ...] = ("forest",), folds: int = 5, trees: int = 200, rounds: int = 200) -> DataFrame:
    """M3: (model, fold, accuracy, f1): each kind fitted `folds` times, every time told of the fold that it did not see.

    A row's fold comes from a hash of key and label, so that labels are spread over folds and reruns agree. Medians and
    weights are those of the rows that a fit sees.
    """
    dealt, n = rows.withColumn("_fold", F.pmod(F.xxhash64(key, label), F.lit(folds)).cast("int")), rows.count()
    found = []
    for fold in range(folds):
        filled = imputed(dealt, features, fitted_to=dealt.filter(F.col("_fold") != fold))
        train = spread(saved(balanced(filled.filter(F.col("_fold") != fold), label)), n)
        test = spread(filled.filter(F.col("_fold") == fold), n).withColumn("weight", F.lit(1.0))
        for kind in kinds:
            scored = saved(classifier(kind, features, label, trees, rounds).fit(train).transform(test).select("label", "prediction"))
            m = metrics(scored) if not scored.isEmpty() else {"accuracy": None, "f1": None}
            found.append((kind, fold, m["accuracy"], m["f1"]))
    return rows.sparkSession.createDataFrame(found, "model string, fold int, accuracy double, f1 double")


def class_report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """M3: (label, precision, recall, f1, support) of each label, and of 'accuracy' (in f1), 'macro avg' and 'weighted avg'. A label that is never predicted has precision 0."""
    pairs = scored.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select("l", F.explode(F.array("l", "p")).alias("label"), "p", "n").distinct()  # a row a pair and label
    sums = each.groupBy("label").agg(F.sum(F.when((F.col("l") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("hit"),
                                     F.sum(F.when(F.col("l") == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)).alias("told"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    one = sums.select("label", ratio("hit", "told").alias("precision"), ratio("hit", "support").alias("recall"), F.coalesce(F.try_divide(2 * F.col("hit"), F.col("told") + F.col("support")), F.lit(0.0)).alias("f1"), "support", "hit")
    measures = ("precision", "recall", "f1")
    whole = one.agg(*(F.avg(c).alias(f"m_{c}") for c in measures), *((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in measures), (F.sum("hit") / F.sum("support")).alias("acc"), F.sum("support").alias("support"))
    null = F.lit(None).cast("double")
    return one.drop("hit").union(whole.select(F.lit("accuracy"), null, null, "acc", "support")).union(whole.select(F.lit("macro avg"), "m_precision", "m_recall", "m_f1", "support")).union(whole.select(F.lit("weighted avg"), "w_precision", "w_recall", "w_f1", "support"))


def rank_auc(scored: DataFrame, label: str, chances: dict[str, str]) -> DataFrame:
    """M3: (label, auc, positives): for each label the chance that a row of it scores above one of another, ties half; chances: label to its score's column.

    Rows of one score are counted first; counts are then summed along the scores by sampled ranges (relational.running), so no
    task sorts all rows. A label without rows, or without others, has a null.
    """
    pairs = F.array(*(F.struct(F.lit(x).alias("of"), F.col(c).cast("double").alias("s"), (F.col(label) == x).cast("long").alias("hit")) for x, c in chances.items()))
    counts = scored.select(F.explode(pairs).alias("x")).groupBy("x.of", "x.s").agg(F.sum("x.hit").alias("pos"), F.sum(1 - F.col("x.hit")).alias("neg"))
    out = None
    for x in chances:
        own = running(counts.filter(F.col("of") == x).withColumn("down", -F.col("s")), "down", "s", F.col("neg"))  # by rising score
        one = own.agg(F.sum(F.col("pos") * (F.col("running") - F.col("neg") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("positives"), F.sum("neg").alias("others"))
        one = one.select(F.lit(x).alias("label"), F.try_divide("wins", F.col("positives") * F.col("others")).cast("double").alias("auc"), "positives")
        out = one if out is None else out.union(one)
    return out


def best_model(rows: DataFrame, features: list[str], label: str, key: str = "vendor_id", exclude_leaky: bool = True, trees: int = 200, rounds: int = 200) -> tuple[PipelineModel, DataFrame]:
    """M3: the kind with the better weighted F1 on held-out rows, and (model, accuracy, f1) of both.

    Boosted trees draw no rows, so they are fitted to rows alike as one, or two, with their number: to the same sums.
    """
    features = [f for f in features if not (exclude_leaky and f == LEAKY)]
    train, test = stratified_split(imputed(rows, features), key, label)
    seen = {"forest": balanced(condensed(train, features, label), label, "rows"), "boosted": condensed(train, features, label, drawn=0)}
    test, found = condensed(test, features, label, drawn=0), []
    for kind in ("forest", "boosted"):
        model = classifier(kind, features, label, trees, rounds, times="rows").fit(seen[kind])
        found.append((kind, model, metrics(model.transform(test), "rows")))
    table = rows.sparkSession.createDataFrame([(k, m["accuracy"], m["f1"]) for k, _, m in found], "model string, accuracy double, f1 double")
    return max(found, key=lambda x: x[2]["f1"])[1], table


def predictions(model: PipelineModel, rows: DataFrame, features: list[str], key: str, run_id: str) -> DataFrame:
    """M4, Q11: (key, predicted, confidence, run_id): the likeliest label by the fitted index, and its chance where the model gives one.

    Rows alike in features are told once and joined back, as a model takes long for a row.
    """
    whole = imputed(rows.select(key, *features), features)
    alike = saved(whole.select(*features).distinct())
    scored = model.transform(spread(alike, alike.count()))
    names = F.array(*map(F.lit, [*model.stages[0].labels, "unknown"]))
    confidence = F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.lit(None).cast("double")
    told = saved(scored.select(*features, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), confidence.alias("confidence")), alike)
    return whole.join(told, features).select(key, "predicted", "confidence", F.lit(run_id).alias("run_id"))


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """M5: (feature, importance, pct) of a forest, the largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
    return with_totals(rows, _all=F.sum("importance")).select("feature", "importance", (F.col("importance") / F.col("_all") * 100).alias("pct")).orderBy(F.desc("importance"), "feature")


#: Sparse vectors as Arrow holds them.
SPARSE = pa.struct([pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))), pa.field("values", pa.list_(pa.field("element", pa.float64(), False)))])


class Sublinear(Transformer):
    """Words and pairs of words in an array of words, as sparse vectors by the given lists: n mentions count as 1 + ln n, so that
    a word's tenth mention weighs less than its first. The array goes. A pair is two words with a blank between them."""

    def __init__(self, inputCol: str, words: list[str], pairs: list[str], outputCols: list[str]):
        super().__init__()
        self.inputCol, self.words, self.pairs, self.outputCols = inputCol, words, pairs, outputCols

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, outs, words, halves = self.inputCol, self.outputCols, self.words, [p.split(" ", 1) for p in self.pairs]
        rest = [f for f in dataset.schema.fields if f.name != name]
        shared = dataset.sparkSession.sparkContext.broadcast((words, halves))

        def vectors(row: np.ndarray, at: np.ndarray, size: int, n: int) -> pa.StructArray:
            found, times = np.unique(row * size + at, return_counts=True)
            ends = pa.array(np.searchsorted(found, np.arange(n + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x), type=SPARSE.field(i).type) for i, x in ((2, (found % size).astype(np.int32)), (3, 1 + np.log(times)))]
            return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], fields=list(SPARSE))

        def each(batches):
            words, halves = shared.value
            known = list(dict.fromkeys([*words, *(h for p in halves for h in p)]))  # words keep their places
            place = {w: i for i, w in enumerate(known)}
            pairs = np.array([place[a] * len(known) + place[b] for a, b in halves], np.int64)
            order, known = np.argsort(pairs), pa.array(known, pa.string())
            pairs = pairs[order]
            for batch in batches:
                row, word = _flat(batch.column(name))
                at = pc.fill_null(pc.index_in(word, value_set=known), -1).to_numpy().astype(np.int64)
                one = (at >= 0) & (at < len(words))
                two = (row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
                pair, where = at[:-1][two] * len(known) + at[1:][two], row[1:][two]
                near = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                hit = pairs[near] == pair
                made = vectors(row[one], at[one], len(words), len(batch)), vectors(where[hit], order[near[hit]], len(pairs), len(batch))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *made], names=[*(f.name for f in rest), *outs])

        return dataset.mapInArrow(each, StructType([*rest, *(StructField(c, VectorUDT()) for c in outs)]))


def _flat(words: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The words of a batch's arrays in a row, and of which array each is."""
    return pc.list_parent_indices(words).to_numpy().astype(np.int64), words.flatten().cast(pa.string())


def frequent_terms(rows: DataFrame, words: str, most: int, pairs: bool = False) -> list[str]:
    """The `most` commonest words, or pairs of adjacent words, of arrays of words, that at least two rows have; the commonest first, ties by term.

    Rows are counted in their tasks, so that a batch's number of a term goes through the shuffle and not each mention.
    """

    def counted(batches):
        for batch in batches:
            row, word = _flat(batch.column(words))
            coded = word.dictionary_encode()
            at, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            if pairs:
                same = row[1:] == row[:-1]
                at, row = (at[:-1] * size + at[1:])[same], row[1:][same]
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            last = np.append(first[1:], len(order)) - 1 if len(first) else first
            found = at[order][first]
            named = lambda x: coded.dictionary.take(pa.array(x))
            term = pc.binary_join_element_wise(named(found // size), named(found % size), " ") if pairs else named(found)
            several = row[order][first] != row[order][last]
            yield pa.RecordBatch.from_arrays([term, pa.array(last - first + 1), pa.array(1 + several.astype(np.int64))], names=["term", "n", "texts"])

    sums = rows.select(words).mapInArrow(counted, "term string, n long, texts long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    best = saved(sums.filter("texts > 1").select("term", "n").orderBy(F.desc("n"), "term").limit(most))
    return [r["term"] for r in best.orderBy(F.desc("n"), "term").collect()]


def text_classifier(rows: DataFrame, text: str, label: str, vocabulary: int = 5000) -> PipelineModel:
    """M6: sublinear TF-IDF of words and pairs of words with a weighted logistic regression; rows need weight (see balanced).

    Texts are parted once and saved, and so are their counts and their features, which fits read again.
    """
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows), RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+")]
    parted = saved(PipelineModel(stages).transform(rows).select("label", "weight", "_w"))
    # a list may not be empty: a blank is no word, and two are no pair
    count = Sublinear("_w", frequent_terms(parted, "_w", vocabulary) or [" "], frequent_terms(parted, "_w", vocabulary, pairs=True) or ["  "], ["_sw", "_sb"])
    counted = saved(count.transform(parted), parted)
    weigh = [IDF(inputCol=f"_s{c}", outputCol=f"_i{c}").fit(counted) for c in ("w", "b")]
    join = [VectorAssembler(inputCols=["_iw", "_ib"], outputCol="_all"), Normalizer(inputCol="_all", outputCol="features")]
    made = saved(PipelineModel([*weigh, *join]).transform(counted).select("label", "weight", "features"), counted)
    model = LogisticRegression(maxIter=500, regParam=0.01, weightCol="weight").fit(spread(made, made.count()))
    discard(made)
    return PipelineModel([*stages, count, *weigh, *join, model])


def scaled_vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    stages = [VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True)]
    data = imputed(rows, features)
    return Pipeline(stages=stages).fit(data).transform(data).drop("_v")


def kmeans(rows: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> tuple[DataFrame, float]:
    """M7: rows with cluster_id, and the silhouette."""
    data = scaled_vectors(spread(rows, rows.count()), features).persist()  # every iteration reads it
    out = clustered(data, k, seed)
    data.unpersist()
    return out, ClusteringEvaluator(predictionCol="cluster_id").evaluate(out)


def clustered(data: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Rows with features, which should be persisted, and their cluster_id; saved."""
    return saved(KMeans(k=k, seed=seed, maxIter=300, predictionCol="cluster_id").fit(data).transform(data))


def best_k(rows: DataFrame, features: list[str], ks: range = range(2, 9)) -> DataFrame:
    """M8: (k, silhouette, davies_bouldin), for 2 to 8 clusters. Figures are scaled once, and over all cores."""
    data, found = scaled_vectors(spread(rows.select(*features), rows.count()), features).select("features").persist(), []
    for k in ks:
        out = clustered(data, k)
        found.append((k, float(ClusteringEvaluator(predictionCol="cluster_id").evaluate(out)), davies_bouldin(out)))
    data.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double, davies_bouldin double")


def davies_bouldin(clustered: DataFrame) -> float:
    """M8: from centres and mean distances, which are k rows."""
    x = clustered.select("cluster_id", F.posexplode(vector_to_array("features")).alias("i", "x"))
    centre = x.groupBy("cluster_id", "i").agg(F.avg("x").alias("c"))
    rows = clustered.select("cluster_id", F.monotonically_increasing_id().alias("_n"), F.posexplode(vector_to_array("features")).alias("i", "x"))
    far = rows.join(F.broadcast(centre), ["cluster_id", "i"]).groupBy("cluster_id", "_n").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d")).groupBy("cluster_id").agg(F.avg("d").alias("s"))
    spread = {r["cluster_id"]: r["s"] for r in far.collect()}
    points: dict = {}
    for r in centre.collect():
        points.setdefault(r["cluster_id"], {})[r["i"]] = r["c"]
    gap = lambda a, b: sum((points[a][i] - points[b][i]) ** 2 for i in points[a]) ** 0.5
    worst = [max((spread[a] + spread[b]) / max(gap(a, b), 1e-12) for b in spread if b != a) for a in spread if len(spread) > 1]
    return sum(worst) / len(worst) if worst else 0.0


#: Names of clusters and what to do about them, by high risk, high spend and high performance against the medians of all rows.
CLUSTER_ACTIONS = {
    "Critical High-Spend": "Priority 1: Immediate risk mitigation + dual sourcing",
    "Vulnerable Low-Spend": "Priority 2: Monitor closely, qualify alternatives",
    "Stable Strategic": "Priority 3: Leverage spend, deepen partnership",
    "Reliable Tactical": "Priority 4: Maintain, automate processes",
    "Underperforming Tail": "Priority 5: Review, consolidate or exit",
}


def cluster_profile(clustered: DataFrame, risk: str = "composite_risk_score", spend: str = "total_spend", performance: str = "performance_composite", more: list[str] | None = None) -> DataFrame:
    """(cluster_id, vendors, mean_.., cluster_label, cluster_action): each cluster's size and means, and its name by how its means lie to the medians of all rows."""
    middle = exact_quantiles(clustered, {c: [0.5] for c in (risk, spend, performance)})
    rows = clustered.groupBy("cluster_id").agg(F.count("*").alias("vendors"), *(F.avg(c).alias(f"mean_{c}") for c in (risk, spend, performance, *(more or []))))
    high = {c: F.col(f"mean_{c}") > F.lit(middle[c][0]) for c in (risk, spend, performance)}
    critical, vulnerable, stable, reliable, tail = CLUSTER_ACTIONS
    name = F.when(high[risk] & high[spend], critical).when(high[risk], vulnerable).when(high[spend], stable).when(high[performance], reliable).otherwise(tail)
    return rows.withColumn("cluster_label", name).withColumn("cluster_action", mapped("cluster_label", CLUSTER_ACTIONS, ""))


def pca2(rows: DataFrame, features: list[str], key: str = "vendor_id") -> DataFrame:
    """M9: (key, pc1, pc2) of centred, scaled features."""
    data = scaled_vectors(rows, features)
    out = PCA(k=2, inputCol="features", outputCol="_p").fit(data).transform(data).withColumn("_a", vector_to_array("_p"))
    return out.select(key, F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"))
