"""Model jobs on pyspark.ml, and deterministic splits and samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import is_real_description
from postlens.operators.retrieval import pack
from postlens.sources.files import save


def _order(key: str) -> list:
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def _places(df: DataFrame, key: str, label: str) -> DataFrame:
    """``_r``, the place of a row in its class by hash order, and ``_n``, the rows of the class.

    A class is numbered in parts by the first digits of the hash, each from the number of rows before it, so no task gets a whole class.
    """
    rows = df.withColumn("_part", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    sizes = rows.groupBy(label, "_part").agg(F.count("*").alias("_size"))  # at most 4,097 rows for each class
    w = Window.partitionBy(label).orderBy("_part")
    before = sizes.select(F.col(label).alias("_l"), F.col("_part").alias("_p"), (F.sum("_size").over(w) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(label)).alias("_n"))
    met = rows.join(F.broadcast(before), F.col(label).eqNullSafe(F.col("_l")) & F.col("_part").eqNullSafe(F.col("_p")))
    own = F.row_number().over(Window.partitionBy(label, "_part").orderBy(*_order(key)))
    return met.withColumn("_r", own + F.col("_before")).drop("_part", "_l", "_p", "_before")


def stratified_split(df: DataFrame, key: str, label: str, test: float) -> DataFrame:
    """``test`` marks the first share of each class by hash order: the same rows on every run."""
    return _places(df, key, label).withColumn("test", F.col("_r") <= test * F.col("_n")).drop("_r", "_n")


def stratified_sample(df: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """Exactly ``n`` rows, dealt round the classes."""
    r = F.row_number().over(Window.partitionBy(label).orderBy(*_order(key)))
    return df.withColumn("_r", r).where(F.col("_r") <= n).orderBy("_r", *_order(key)).limit(n).drop("_r")


def training_rows(df: DataFrame, key: str, label: str, title: str, text: str, spellings: dict[str, str], least: int, test: float) -> DataFrame:
    """``key, label, text, test``: one spelling of each class, the title and the text where it is a real one, classes of ``least`` rows or more."""
    table = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    real = F.when(is_real_description(F.col(text)), F.col(text))
    rows = df.where(F.col(label).isNotNull()).select(key, F.coalesce(F.try_element_at(table, F.col(label)), F.col(label)).alias(label), F.concat_ws(" ", title, real).alias("text"))
    many = rows.withColumn("_n", F.count("*").over(Window.partitionBy(label))).where(F.col("_n") >= least).drop("_n")
    return stratified_split(many, key, label, test)


def text_pipeline(features: int = 1 << 14) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern="\\W+", minTokenLength=2), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features", minDocFreq=2), LogisticRegression(weightCol="weight", maxIter=2000, regParam=0.01),
    ])


def balanced(df: DataFrame) -> DataFrame:
    """Class weights that make every class count the same (one row for each class is broadcast)."""
    n = df.groupBy("label").agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n.crossJoin(n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k")))), "label").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n")))


def text_classifier(df: DataFrame) -> PipelineModel:
    """TF-IDF and balanced logistic regression over ``text, label``."""
    return text_pipeline().fit(balanced(df))


class MacroF1(Evaluator):
    """Mean over the classes of their F1 (``f1`` of the multiclass evaluator weighs classes by their size)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        n = dataset.groupBy("label", "prediction").count().collect()  # a row for each pair of classes
        f1 = []
        for c in {r["label"] for r in n} | {r["prediction"] for r in n}:
            hit = sum(r["count"] for r in n if r["label"] == r["prediction"] == c)
            seen = sum(r["count"] * ((r["label"] == c) + (r["prediction"] == c)) for r in n)
            f1.append(2 * hit / seen)
        return sum(f1) / len(f1) if f1 else 0.0

    def isLargerBetter(self) -> bool:
        return True


def stratified_folds(df: DataFrame, key: str, label: str, most: int = 5) -> tuple[DataFrame, int]:
    """``fold`` deals each class round by hash order; there are at most ``most`` folds, no more than the smallest class has rows, and at least 2."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    folds = max(2, min(most, least))
    return _places(df, key, label).withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_r", "_n"), folds


#: Values that the grid search tries: terms, single words or pairs too, least documents, and inverse strength.
GRID = {"vocabSize": (1500, 3000, 5000), "inputCol": ("_one", "_both"), "minDF": (1.0, 2.0), "c": (0.1, 1.0, 5.0, 10.0)}
#: Passes over the rows at most, the largest entry of a gradient (per unit of weight) that counts as settled, least rows of a task, and cells of a block of rows by terms.
PASSES, SETTLED, ROWS_A_TASK, CELLS = 2000, 1e-4, 500, 1 << 21


@dataclass
class Space:
    """A vocabulary of one fold's training rows: terms by their number, inverse document frequencies, and the combinations of the grid that lead to it."""

    fold: int
    names: list[tuple]
    terms: np.ndarray
    idf: np.ndarray


class Descent:
    """L-BFGS of several models over the same rows, each with its own steps; one evaluation of all of them at a time.

    ``curve`` (models by weights) is the second derivative along each weight at the start: steps begin from it, as the intercept's is hundreds of times a word's.
    """

    def __init__(self, curve: np.ndarray, memory: int = 30) -> None:
        models, size = curve.shape
        self.curve = curve
        self.w, self.trial = np.zeros((models, size)), np.zeros((models, size))
        self.value, self.slope = np.full(models, np.inf), np.zeros(models)
        self.gradient, self.direction = np.zeros((models, size)), np.zeros((models, size))
        self.step, self.settled = np.ones(models), np.zeros(models, bool)
        self.past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(models)]
        self.memory = memory

    def tell(self, values: np.ndarray, gradients: np.ndarray, scale: float) -> None:
        """Objective and gradient at ``trial``; makes the next trial."""
        for m in np.flatnonzero(~self.settled):
            if values[m] <= self.value[m] + 1e-4 * self.step[m] * self.slope[m] or self.step[m] < 1e-10:
                if np.isfinite(self.value[m]):
                    s, y = self.trial[m] - self.w[m], gradients[m] - self.gradient[m]
                    if s @ y > 1e-12 * (y @ y):
                        self.past[m] = [*self.past[m], (s, y)][-self.memory :]
                flat = self.step[m] < 1e-10
                self.w[m], self.value[m], self.gradient[m] = self.trial[m], values[m], gradients[m]
                if flat or np.abs(gradients[m]).max() <= SETTLED * scale:
                    self.settled[m] = True
                    continue
                self.direction[m] = -self.along(m)
                self.slope[m] = self.direction[m] @ self.gradient[m]
                self.step[m] = 1.0
            else:
                self.step[m] /= 2
            self.trial[m] = self.w[m] + self.step[m] * self.direction[m]

    def along(self, m: int) -> np.ndarray:
        q, kept = self.gradient[m].copy(), []
        for s, y in reversed(self.past[m]):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        q /= self.curve[m]
        if self.past[m]:
            s, y = self.past[m][-1]
            q *= (s @ y) / (y @ (y / self.curve[m]))
        for (s, y), a in zip(self.past[m], reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return q


def _counted(df: DataFrame, folds: int, grid: dict) -> list[Space]:
    """The vocabularies of every fold, kind of terms and least frequency; each size is a prefix of the commonest terms. Combinations with the same one share it."""
    each = df.withColumn("_row", F.monotonically_increasing_id()).select("_row", "fold", F.explode(F.concat(F.transform("_one", lambda w: F.struct(w.alias("term"), F.lit(True).alias("one"))), F.transform("_two", lambda w: F.struct(w.alias("term"), F.lit(False).alias("one"))))).alias("t"))
    tf = each.groupBy("_row", "fold", F.col("t.term").alias("term"), F.col("t.one").alias("one")).agg(F.count("*").alias("tf"))
    by_fold = tf.groupBy("term", "one").agg(*[F.sum(F.when(F.col("fold") != f, F.col("tf")).otherwise(0)).alias(f"n{f}") for f in range(folds)], *[F.count(F.when(F.col("fold") != f, 1)).alias(f"d{f}") for f in range(folds)])
    by_fold = save(by_fold, "grid-terms")
    rows = df.groupBy("fold").count().collect()
    most, out = max(grid["vocabSize"]), []
    same: dict[tuple, Space] = {}
    for f in range(folds):
        n = sum(r["count"] for r in rows if r["fold"] != f)
        for column in grid["inputCol"]:
            for least in grid["minDF"]:
                mine = by_fold if column == "_both" else by_fold.where("one")
                top = mine.where((F.col(f"d{f}") >= (least if least >= 1 else least * n)) & (F.col(f"n{f}") > 0)).orderBy(F.desc(f"n{f}"), "term").limit(most).select("term", f"d{f}").collect()  # bounded by the grid
                for size in grid["vocabSize"]:
                    key = (f, *top[:size])
                    if key not in same:
                        same[key] = Space(f, [], np.array([r.term for r in top[:size]], object), np.log((n + 1) / (np.array([r[1] for r in top[:size]], float) + 1)))
                        out.append(same[key])
                    same[key].names.append((size, column, least))
    return out


def tuned(df: DataFrame, key: str = "doc_id", most: int = 5, grid: dict = GRID) -> list[tuple[dict, float]]:
    """Each combination of the grid with its macro-averaged F1, the mean over stratified folds, best first.

    ``df`` has text and label (0 or 1). All models of all folds are fitted together: a pass over the rows adds up loss and gradient of every
    model (``c`` times the weighted log loss, and half the squared weights), and each model takes its own L-BFGS step, until every gradient
    is at most ``SETTLED`` per unit of weight or ``PASSES`` passes are done. Rows stay where they are; what moves is a gradient of each model for each task.

    Rows hold counts of terms, which all spaces share; a space's frequencies go into the weights, and the lengths of a row in each space stand
    beside it. So a block of rows meets the unsettled models of all spaces of one kind and size in two products of matrices.
    """
    spark = df.sparkSession
    most_tasks = 2 * spark.sparkContext.defaultParallelism
    df = save(df.select(key, "text", "label").repartition(most_tasks, key), "grid-texts")  # texts of one file are not left to one task
    dealt, folds = stratified_folds(balanced(df), key, "label", most)
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) >= 2)
    stop = StopWordsRemover(inputCol="_all", outputCol="_one")
    rows = stop.transform(dealt.withColumn("_all", F.coalesce(words, F.array().cast("array<string>"))))
    rows = NGram(n=2, inputCol="_one", outputCol="_two").transform(rows).select("fold", F.col("label").cast("double").alias("label"), "weight", "_one", "_two")
    rows = save(rows.repartition(most_tasks), "grid-rows")
    spaces = _counted(rows, folds, grid)
    names = sorted({t for s in spaces for t in s.terms})
    number = {t: i for i, t in enumerate(names)}
    for s in spaces:
        s.terms = np.array([number[t] for t in s.terms], np.int64)
    strengths = np.array(grid["c"], float)

    def count(batches):
        at, spaces = shared_names.value, shared_spaces.value
        squares = np.zeros((len(spaces), len(at)))
        for k, s in enumerate(spaces):
            squares[k, s.terms] = s.idf * s.idf
        for b in batches:
            ids, tf = [], []
            for one, two in zip(b.column("_one").to_pylist(), b.column("_two").to_pylist()):
                n = Counter(at[t] for t in (*one, *two) if t in at)
                ids.append(list(n.keys()))
                tf.append([float(x) for x in n.values()])
            ids, tf = pa.array(ids, pa.list_(pa.int64())), pa.array(tf, pa.list_(pa.float64()))
            row, term, x = np.repeat(np.arange(b.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False)), ids.flatten().to_numpy(), tf.flatten().to_numpy()
            norms = np.sqrt(np.stack([np.bincount(row, x * x * q[term], b.num_rows) for q in squares], 1))
            inverse = pa.array(list(np.where(norms > 0, 1 / np.where(norms > 0, norms, 1), 0.0)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("label"), b.column("weight"), ids, tf, inverse], ["fold", "label", "weight", "ids", "tf", "inverse"])

    shared_names = spark.sparkContext.broadcast(number)  # at most the vocabularies of the grid
    shared_spaces = spark.sparkContext.broadcast(spaces)
    kind = "fold int, label double, weight double, ids array<long>, tf array<double>, inverse array<double>"
    tasks = max(1, min(-(-rows.count() // ROWS_A_TASK), most_tasks))
    packed = save(rows.mapInArrow(count, kind).repartition(tasks), "grid-packed")
    weights = {r.fold: r.w for r in packed.groupBy("fold").agg(F.sum("weight").alias("w")).collect()}
    scale = [sum(w for f, w in weights.items() if f != s.fold) for s in spaces]

    def blocks(batches):
        """Rows by terms as a matrix of counts, with what rows have beside it: label, the weight in each space (0 in its test fold), whether they test it, and 1 over the length there."""
        width, folds = len(shared_names.value), np.array([s.fold for s in shared_spaces.value])
        step = max(1, CELLS // max(1, width))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                lists = b.column("ids")
                x = np.zeros((b.num_rows, width))
                x[np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = b.column("tf").flatten().to_numpy()
                test = b.column("fold").to_numpy()[:, None] == folds
                yield x, b.column("label").to_numpy()[:, None], np.where(test, 0.0, b.column("weight").to_numpy()[:, None]), test, b.column("inverse").flatten().to_numpy().reshape(b.num_rows, -1)

    def stacked(points: list[np.ndarray], some: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The chosen models as columns, those of spaces of one kind and size together: the terms that any of them has, weights of counts, intercepts, and the space of each."""
        kinds: dict[tuple, list[int]] = {}
        for k, s in enumerate(shared_spaces.value):
            if len(some[k]):
                kinds.setdefault(s.names[0][:2], []).append(k)
        out = []
        for ks in kinds.values():
            terms, of = np.unique(np.concatenate([shared_spaces.value[k].terms for k in ks])), np.repeat(ks, [len(some[k]) for k in ks])
            w, first = np.zeros((len(terms), len(of))), np.zeros(len(of))
            for k in ks:
                s, p, at = shared_spaces.value[k], points[k][some[k]], np.flatnonzero(of == k)
                w[np.searchsorted(terms, s.terms)[:, None], at] = (p[:, :-1] * s.idf).T
                first[at] = p[:, -1]
            out.append((terms, w, first, of))
        return out

    def summed(run) -> dict[int, np.ndarray]:
        """What ``run`` tells of the rows of each task, (space, numbers), added up by space."""

        def told(batches):
            for k, v in run(batches):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], ["space", "v"])

        def add(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(b.column("space").to_pylist(), b.column("v").to_pylist()):
                    held[k] = held.get(k, 0.0) + np.frombuffer(v)
            yield from (pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], ["space", "v"]) for k, v in held.items())

        parts = packed.mapInArrow(told, "space int, v binary")  # bytes, as an array of numbers would be copied one by one
        if tasks > 1:
            parts = parts.repartition(min(len(spaces), tasks), "space").mapInArrow(add, "space int, v binary")
        return {b: np.frombuffer(v) for r in parts.toArrow().to_batches() for b, v in zip(r.column("space").to_pylist(), r.column("v").to_pylist())}

    def curves(batches):
        """Squared values of a term, a quarter of each row's weight: second derivatives of the loss at the start."""
        total, all_ = np.zeros((len(shared_names.value), len(shared_spaces.value))), np.zeros(len(shared_spaces.value))
        for x, _, weight, _, inverse in blocks(batches):
            total += (x * x).T @ (weight * inverse * inverse / 4)
            all_ += weight.sum(0) / 4
        for k, s in enumerate(shared_spaces.value):
            yield k, np.append(total[s.terms, k] * s.idf * s.idf, all_[k])

    def evaluate(points: list[np.ndarray], some: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast((points, some))

        def run(batches):
            groups = stacked(*shared.value)
            sums = [(np.zeros(len(of)), np.zeros_like(w), np.zeros(len(of))) for _, w, _, of in groups]
            for every, label, weights, _, inverses in blocks(batches):
                for (terms, w, first, of), (loss, slopes, slope) in zip(groups, sums):
                    x, inverse, weight = every[:, terms], inverses[:, of], weights[:, of]
                    z = x @ w * inverse + first
                    loss += ((np.logaddexp(0, z) - label * z) * weight).sum(0)
                    off = (1 / (1 + np.exp(-z)) - label) * weight
                    slopes += x.T @ (off * inverse)
                    slope += off.sum(0)
            for (terms, _, _, of), (loss, slopes, slope) in zip(groups, sums):
                for k in np.unique(of).tolist():
                    s, at = shared_spaces.value[k], np.flatnonzero(of == k)
                    yield k, np.column_stack([loss[at], slopes[np.searchsorted(terms, s.terms)][:, at].T * s.idf, slope[at]])

        told = summed(run)
        shared.destroy()
        out = {}
        for k, which in enumerate(some):
            if len(which):
                both = told[k].reshape(len(which), -1) if k in told else np.zeros((len(which), points[k].shape[1] + 1))
                w = points[k][which]
                penalty = w.copy()
                penalty[:, -1] = 0
                value, gradient = np.zeros(len(points[k])), np.zeros_like(points[k])
                value[which] = strengths[which] * both[:, 0] + 0.5 * (penalty * penalty).sum(1)
                gradient[which] = strengths[which, None] * both[:, 1:] + penalty
                out[k] = value, gradient
        return out

    bent = summed(curves)
    models = []
    for k, s in enumerate(spaces):
        curve = strengths[:, None] * bent.get(k, np.zeros(len(s.terms) + 1))
        curve[:, :-1] += 1
        models.append(Descent(np.maximum(curve, 1e-12)))
    for _ in range(PASSES):
        some = [np.flatnonzero(~m.settled) for m in models]
        if not any(map(len, some)):
            break
        for k, (value, gradient) in evaluate([m.trial for m in models], some).items():
            models[k].tell(value, gradient, scale[k])
    fitted = spark.sparkContext.broadcast([m.w for m in models])

    def predict(batches):
        groups = stacked(fitted.value, [np.arange(len(p)) for p in fitted.value])
        cells = [np.zeros((len(of), 4), np.int64) for *_, of in groups]
        for x, label, _, test, inverse in blocks(batches):
            for (terms, w, first, of), n in zip(groups, cells):
                cell = label.astype(np.int64) * 2 + (x[:, terms] @ w * inverse[:, of] + first > 0)
                for i in range(4):
                    n[:, i] += ((cell == i) & test[:, of]).sum(0)
        for (*_, of), n in zip(groups, cells):
            at, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(of[at], pa.int32()), pa.array(at % len(strengths), pa.int32()), pa.array(cell, pa.int32()), pa.array(n[at, cell])], ["space", "model", "cell", "n"])

    cells: dict[tuple, dict[int, int]] = {}
    for r in packed.mapInArrow(predict, "space int, model int, cell int, n long").groupBy("space", "model", "cell").agg(F.sum("n").alias("n")).collect():
        cells.setdefault((r.space, r.model), {})[r.cell] = r.n
    mean: dict[tuple, list[float]] = {}
    for (k, m), n in cells.items():
        f1 = [2 * n.get(3 * c, 0) / seen for c in (0, 1) if (seen := sum(v * ((cell // 2 == c) + (cell % 2 == c)) for cell, v in n.items()))]
        for name in spaces[k].names:
            mean.setdefault((*name, grid["c"][m]), []).append(sum(f1) / len(f1))
    found = [(dict(zip(("vocabSize", "inputCol", "minDF", "c"), k)), sum(v) / len(v)) for k, v in mean.items()]
    return sorted(found, key=lambda x: (-x[1], str(x[0])))


def top_classes(scored: DataFrame, key: str, k: int = 3) -> DataFrame:
    p = vector_to_array("probability")
    each = F.transform(p, lambda x, i: F.struct(F.round(x, 6).alias("p"), i.alias("label")))
    return scored.select(key, F.col("prediction"), F.round(F.array_max(p), 6).alias("confidence"), F.slice(F.sort_array(each, False), 1, k).alias("top")).select(key, "prediction", "confidence", F.to_json("top").alias("top"))


def topics(df: DataFrame, k: int, words: int) -> DataFrame:
    """LDA topics with their first words (another objective than a factorisation by squared error)."""
    m = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="_w", pattern="\\W+", minTokenLength=4), CountVectorizer(inputCol="_w", outputCol="features", vocabSize=1500, minDF=2), LDA(k=k, maxIter=8, seed=42)]).fit(df)
    vocabulary = F.array(*map(F.lit, m.stages[1].vocabulary))
    t = m.stages[2].describeTopics(words)
    return t.select("topic", F.posexplode("termIndices").alias("place", "_i")).select("topic", "place", F.element_at(vocabulary, F.col("_i") + 1).alias("term"))


def _sums(parts: DataFrame) -> dict[int, float]:
    return {r.cell: r.v for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect()}


def factors(index: DataFrame, key: str, topics: int = 6, rounds: int = 20, sweeps: int = 25, seed: int = 42) -> tuple[np.ndarray, list[str], list[float]]:
    """Non-negative factorisation of a sparse table ``(key, term, weight)``, or a packed index: topics by terms, the terms, and the squared error of each round.

    A round is one pass over the rows, packed by ``key``: each task takes the best non-negative shares of its rows in the topics (coordinate
    descent on the small Gram matrix), and adds up what the multiplicative update of the topics needs: shares by terms and shares by shares.
    Spark sums those cells; the driver holds topics by terms, both bounded (the index keeps its commonest terms). Shares are not stored, as
    they follow from the topics. Neither step can raise the error.
    """
    packed = save(pack(index, key), "factored")
    names = [r.term for r in packed.select(F.explode("terms.term").alias("term")).distinct().orderBy("term").collect()]
    at, width = {t: i for i, t in enumerate(names)}, len(names)
    rng = np.random.default_rng(seed)
    h = rng.random((topics, width)) + 0.1
    errors: list[float] = []

    def one_pass(h: np.ndarray) -> dict[int, float]:
        shared = packed.sparkSession.sparkContext.broadcast((h, at))

        def run(batches):
            h, at = shared.value
            gram = h @ h.T
            cells = np.zeros(topics * width + topics * topics + 1)
            by_term, by_topic = cells[: topics * width].reshape(topics, width), cells[topics * width : -1].reshape(topics, topics)
            for b in batches:
                lists = b.column("terms")
                flat = lists.flatten()
                term = flat.field("term").dictionary_encode()
                ids = np.array([at[t] for t in term.dictionary.to_pylist()], np.int64)[term.indices.to_numpy()]
                x = flat.field("weight").to_numpy()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                to = np.stack([np.bincount(row, x * h[t, ids], b.num_rows) for t in range(topics)], 1)
                w = shares(to, gram, sweeps)
                for t in range(topics):
                    by_term[t] += np.bincount(ids, x * w[row, t], width)
                by_topic += w.T @ w
                cells[-1] += (x * x).sum() - 2 * (w * to).sum() + ((w @ gram) * w).sum()
            some = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "v"])

        told = _sums(packed.select("terms").mapInArrow(run, "cell long, v double"))
        shared.destroy()
        return told

    for _ in range(rounds):
        told = one_pass(h)
        cells = np.zeros(topics * width + topics * topics + 1)
        cells[list(told)] = list(told.values())
        errors.append(float(cells[-1]))
        by_term, by_topic = cells[: topics * width].reshape(topics, width), cells[topics * width : -1].reshape(topics, topics)
        h = h * by_term / np.maximum(by_topic @ h, 1e-12)
    return h, names, errors


def shares(to: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative shares of rows in topics with least squared error: ``to`` is rows times topics, ``gram`` topics times topics."""
    w = np.zeros_like(to)
    for _ in range(sweeps):
        for t in range(to.shape[1]):
            if gram[t, t] > 0:
                w[:, t] = np.maximum(0.0, w[:, t] + (to[:, t] - w @ gram[:, t]) / gram[t, t])
    return w


def topic_words(h: np.ndarray, names: list[str], words: int) -> list[tuple[int, int, str, float]]:
    """``(topic, place, term, weight)`` of each topic's first words; topics by falling norm."""
    order = np.argsort(-np.linalg.norm(h, axis=1), kind="stable")
    return [(k, i, names[j], float(h[t, j])) for k, t in enumerate(order) for i, j in enumerate(np.argsort(-h[t], kind="stable")[:words])]


def embeddings(df: DataFrame, key: str, text: str, encode, size: int) -> DataFrame:
    """Vectors of texts by the user's model, ``encode(list of texts) -> list of vectors``, a batch of texts at a time."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": encode(f[text].fillna("").tolist())})

    return df.select(key, text).mapInPandas(batches, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def hashing_embeddings(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Unit vectors of hashed word counts, as built-in expressions; texts without words give zeros."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[^ \\t-\\r]+"), F.lit(0))
    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(size)).cast("int")
    hashed = df.select(key, F.transform(words, place).alias("_p"))
    terms = hashed.select(key, F.explode("_p").alias("_p")).groupBy(key, "_p").agg(F.count("*").alias("_n"))
    row = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_n"))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_len"))  # at most ``size`` entries
    value = lambda i: F.coalesce(F.try_element_at("_m", i) / F.col("_len"), F.lit(0.0))
    return df.select(key).join(row, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("embedding"))
