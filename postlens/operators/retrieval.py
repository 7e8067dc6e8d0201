"""TF-IDF index as a long table, and cosine search over blocks of it."""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.text import let, lower, plain
from postlens.sources.files import save


def tokens(df: DataFrame, key: str, text: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(lower(text), F.lit(pattern), F.lit(0))).alias("term"))


def _merged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, term numbers and counts of lists of terms, each term of a row once, and the terms by their numbers."""
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    cell, tf = np.unique(row * np.int64(max(1, len(words.dictionary))) + words.indices.to_numpy(), return_counts=True)
    return cell // max(1, len(words.dictionary)), cell % max(1, len(words.dictionary)), tf, words.dictionary


def _lists(rows: int, row: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def counts(df: DataFrame, key: str, text: str, pattern: str = "[a-z]{3,}") -> DataFrame:
    """``(key, terms)``, a row for each text that has any: its terms with their numbers. Texts are counted where they stand, without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                row, term, tf, names = _merged(part.column("words"))
                terms = _lists(part.num_rows, row, {"term": names.take(pa.array(term)), "tf": pa.array(tf.astype(np.int64))})
                yield pa.RecordBatch.from_arrays([part.column(key), terms], [key, "terms"])

    words = df.select(key, F.regexp_extract_all(lower(text), F.lit(pattern), F.lit(0)).alias("words")).where("size(words) > 0")
    return words.mapInArrow(run, f"{key} {kind}, terms array<struct<term:string,tf:bigint>>")


def packed_index(df: DataFrame, key: str, text: str, features: int = 3000, min_df: int = 2, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """``(key, terms)`` with ``terms`` the (term, weight) of a unit row, and ``(term, idf)``: sublinear tf, smoothed idf, the commonest ``features`` terms.

    The vocabulary is bounded by ``features`` and is broadcast. Texts that share a ``key`` are one row, and are brought together only if there are any.
    """
    # Written once: the vocabulary and the index read it, and every projection of queries reads the vocabulary.
    own = save(counts(df, key, text), "counts")
    again = own.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if again.limit(1).count():
        flat = own.join(again, own[key].eqNullSafe(again[key]), "left_semi").select(key, F.explode("terms").alias("t"))
        once = flat.groupBy(key, F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("tf")).groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        own = save(own.join(again, own[key].eqNullSafe(again[key]), "left_anti").unionByName(once), "counts")
    n = df.agg(F.count("*").alias("N"))
    tf = own.select(F.explode("terms").alias("t")).select("t.*")
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("N")))
    vocabulary = save(df_.orderBy(F.desc("cf"), "term").limit(features).select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
    idf = df.sparkSession.sparkContext.broadcast({r.term: r.idf for r in vocabulary.collect()})  # at most ``features``

    def run(batches):
        for b in batches:
            lists = b.column("terms")
            flat = lists.flatten()
            names = flat.field("term").dictionary_encode()
            of = np.array([idf.value.get(x, np.nan) for x in names.dictionary.to_pylist()], np.float64)[names.indices.to_numpy()]
            known = ~np.isnan(of)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known]
            w = (1 + np.log(flat.field("tf").to_numpy()[known])) * of[known]
            weight = w / np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            yield pa.RecordBatch.from_arrays([b.column(key), _lists(b.num_rows, row, {"term": flat.field("term").filter(pa.array(known)), "weight": pa.array(weight)})], [key, "terms"])

    kind = df.schema[key].dataType.simpleString()
    return own.mapInArrow(run, f"{key} {kind}, terms array<struct<term:string,weight:double>>").where("size(terms) > 0"), vocabulary


def index(df: DataFrame, key: str, text: str, features: int = 3000, min_df: int = 2, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """``packed_index`` as ``(key, term, weight)``."""
    packed, vocabulary = packed_index(df, key, text, features, min_df, max_df)
    return packed.select(key, F.explode("terms").alias("_t")).select(key, "_t.term", "_t.weight"), vocabulary


def pack(index_: DataFrame, key: str) -> DataFrame:
    """``(key, terms)`` of an index, as it is if it has that form."""
    return index_ if "terms" in index_.columns else index_.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("terms"))


def project(queries: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Queries in the index's space, with unit rows."""
    tf = tokens(queries, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(vocabulary), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return w.withColumn("q", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).drop("w")


#: Queries that are broadcast at a time, rows of a batch, and rows of a block with bounds of its own.
QUERIES, ROWS, BLOCK = 1024, 8192, 128


class _Queries:
    """Queries of one pass as a matrix of (term, query)."""

    def __init__(self, rows: list) -> None:
        self.ids = sorted({r[0] for r in rows})
        at = {q: i for i, q in enumerate(self.ids)}
        self.terms = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        self.weights = np.zeros((len(self.terms), len(self.ids)))
        for q, t, w in rows:
            self.weights[self.terms[t], at[q]] = w


class _Top:
    """The best ``k`` rows of each query so far, and the score that a further row has to reach."""

    def __init__(self, queries: _Queries, k: int) -> None:
        self.k, self.queries = k, queries
        self.scores = np.full((len(queries.ids), k), -1.0)
        self.rows = np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def take(self, keys: np.ndarray, terms: np.ndarray, weights: np.ndarray, first: np.ndarray) -> None:
        """A batch of rows as (term, weight) lists that begin at ``first``; blocks are visited from the highest bound on."""
        n, v = len(keys), len(self.queries.terms)
        edges = np.append(np.arange(0, n, BLOCK), n)
        block = np.repeat(np.arange(n), np.diff(first)) // BLOCK
        most = np.zeros((len(edges) - 1, v))
        np.maximum.at(most, (block, terms), weights)
        bound = most @ self.queries.weights + 1e-6
        for b in np.argsort(-bound.max(1), kind="stable"):
            alive = np.flatnonzero((bound[b] >= self.scores[:, -1]) & (bound[b] > 1e-6))
            if not len(alive):
                continue
            i, j = edges[b], edges[b + 1]
            dense = np.zeros((j - i, v))
            part = slice(first[i], first[j])
            dense[np.repeat(np.arange(j - i), np.diff(first[i : j + 1])), terms[part]] = weights[part]
            used = np.flatnonzero(most[b])
            self.merge(alive, (dense[:, used] @ self.queries.weights[np.ix_(used, alive)]).T, keys[i:j])

    def merge(self, alive: np.ndarray, raw: np.ndarray, keys: np.ndarray) -> None:
        scores = np.where(raw > 0, np.round(raw, 6), -1.0)
        some = (scores >= self.scores[alive, -1:]).any(1) & (scores >= 0).any(1)
        alive, scores = alive[some], scores[some]
        both = np.concatenate([self.scores[alive], scores], 1)
        rows = np.concatenate([self.rows[alive], np.broadcast_to(keys, scores.shape)], 1)
        rows = np.where(both < 0, np.iinfo(np.int64).max, rows)
        order = np.lexsort((rows, -both), axis=1)[:, : self.k]
        self.scores[alive], self.rows[alive] = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)

    def told(self, query: str, key: str) -> pa.RecordBatch:
        some = self.scores >= 0
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(self.queries.ids), some.sum(1))), pa.array(self.rows[some]), pa.array(self.scores[some])], [query, key, "score"])


def search(index_: DataFrame, key: str, queries: DataFrame, query: str, k: int = 5, least: float = 0.1) -> DataFrame:
    """Top ``k`` by cosine of each query among those of at least ``least``, or the plain top ``k`` if none reaches it. The index may be packed.

    Rows of the index that share their heaviest term stand together in blocks, each with the maximum weight of its terms. The
    queries (a stated set; ids and keys are whole numbers) are broadcast, ``QUERIES`` at a time; a task visits its blocks from the highest bound on and leaves out a
    query where the block's bound does not reach its ``k``-th best so far. No pair becomes a row: a task hands on ``k`` rows for each query.
    """
    spark = index_.sparkSession
    heaviest = F.array_max(F.transform("terms", lambda x: F.struct(x["weight"], x["term"])))["term"]
    packed = pack(index_, key).withColumn("_top", heaviest).sortWithinPartitions("_top").select(F.col(key).cast("long").alias(key), "terms")
    asked = save(queries.select(query, "term", "q"), "queries")
    n = -(-asked.select(query).distinct().count() // QUERIES)
    packed = save(packed, "postings") if n > 1 else packed
    out = []
    for part in range(n):
        rows = asked.where(F.pmod(F.xxhash64(query), F.lit(n)) == part).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(_Queries([tuple(r) for r in rows]))

        def run(batches, shared=shared):
            top = _Top(shared.value, k)
            for b in batches:
                for i in range(0, b.num_rows, ROWS):
                    part = b.slice(i, ROWS)
                    lists = part.column("terms")
                    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    flat = lists.flatten()
                    names = flat.field("term").dictionary_encode()
                    ids = np.array([top.queries.terms.get(t, -1) for t in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                    known = ids >= 0
                    left = np.bincount(np.repeat(np.arange(len(size)), size)[known], minlength=len(size))
                    top.take(part.column(key).to_numpy(), ids[known], flat.field("weight").to_numpy()[known], np.append(0, np.cumsum(left)))
            yield top.told(query, key)

        one = packed.mapInArrow(run, f"{query} long, {key} long, score double")
        out.append(save(one, "found") if n > 1 else one)
        if n > 1:
            shared.destroy()
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"{query} long, {key} long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
    passing = F.max("score").over(Window.partitionBy(query)) >= least
    return ranked.withColumn("_p", passing).where(~F.col("_p") | (F.col("score") >= least)).drop("_p")


_LETTER = r"[\p{L}\p{N}_]"


def spoken(pattern: str) -> str:
    r"""The pattern with words of the letters of all alphabets: ``\w``, and ``\b`` at either end. All else is as in ``plain``."""
    begun = re.sub(r"^\\b", lambda _: f"(?<!{_LETTER})", pattern)
    return plain(re.sub(r"\\b$", lambda _: f"(?!{_LETTER})", begun).replace(r"\w", _LETTER))


def question_type(text: Column, groups: dict[str, list[str]]) -> Column:
    """The group with the most patterns in a text (the first of equal ones), else ``general``. The groups are one literal of the plan."""
    rows = [{"place": -i, "kind": k, "patterns": [spoken(p) for p in ps]} for i, (k, ps) in enumerate(groups.items())]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<place:int,kind:string,patterns:array<string>>>")

    def best(low: Column) -> Column:
        counted = F.transform(table, lambda g: F.struct(F.size(F.filter(g["patterns"], lambda p: F.rlike(low, p))).alias("n"), g["place"].alias("place"), g["kind"].alias("kind")))
        return F.array_max(counted)

    top = let(lower(text), best)
    return F.when(top["n"] > 0, top["kind"]).otherwise("general")


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(spoken(p)) for p in patterns]), lambda p: F.rlike(lower(text), p))


def first_pattern(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that a text holds."""
    return F.coalesce(*[F.when(lower(text).rlike(spoken(p)), F.lit(k)) for k, p in patterns.items()])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries of one pass of ``dense_top``, and values of a product that a task holds at a time.
QUERIES_AT_ONCE, CELLS = 4096, 4_000_000


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Cosine top ``k`` of each row of ``queries`` (a stated set, see the caller; ``QUERIES_AT_ONCE`` go to the tasks in a pass).

    A task multiplies its vectors with the queries, works out the score of what may be among the best ``k`` in the order of the dimensions, and hands on
    at most ``k`` rows of one score. Vectors that are null, zero, not finite or of another length are paired one by one.
    """
    norm = lambda c: F.sqrt(dot(c, c))
    first = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    e = F.col("embedding")
    good = F.coalesce((F.size(e) == (first.n if first else 0)) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e100)) & F.exists(e, lambda x: F.abs(x.cast("double")) > 1e-100), F.lit(False))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), good.alias("_good"))
    v = vectors.select("vec_id", "embedding", good.alias("_fit"))

    def one_by_one(v: DataFrame, q: DataFrame) -> DataFrame:
        pairs = v.crossJoin(q).where("vec_id <> query_id")
        return pairs.select("query_id", "vec_id", (dot(F.col("embedding"), F.col("_q")) / (norm(F.col("embedding")) * norm(F.col("_q")))).alias("score"))

    parts = [one_by_one(v.where("not _fit"), q), one_by_one(v.where("_fit"), q.where("not _good"))]
    passes = -(-q.where("_good").count() // QUERIES_AT_ONCE)
    for i in range(passes):
        rows = q.where(F.col("_good") & (F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)).select("query_id", "_q").collect()
        if rows:
            shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), np.array([r._q for r in rows], np.float64)))
            parts.append(v.where("_fit").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lambda batches, shared=shared: _dense(batches, *shared.value, k), "query_id long, vec_id long, score double"))
    s = reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _along(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up in the order of the dimensions."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _dense(batches, ids: np.ndarray, q: np.ndarray, k: int):
    length, kept = np.sqrt(_along(q, q)), None
    least = np.full(len(ids), -np.inf)  # a score that k vectors reach
    for b in batches:
        for at in range(0, b.num_rows, step := max(k + 1, CELLS // len(ids))):
            part = b.slice(at, step)
            vec = part.column("vec_id").to_numpy()
            x = part.column("embedding").flatten().to_numpy().reshape(len(vec), q.shape[1])
            own = np.sqrt(_along(x, x))
            near = (q @ x.T) / length[:, None] / own
            near[ids[:, None] == vec] = -np.inf
            if len(vec) >= k:
                least = np.maximum(least, np.partition(near, len(vec) - k, axis=1)[:, len(vec) - k])
            who, row = np.nonzero((near >= least[:, None] - 3e-6) & np.isfinite(near))
            new = who, vec[row], _along(x[row], q[who]) / (own[row] * length[who])
            kept = new if kept is None else tuple(map(np.concatenate, zip(kept, new)))
            who, vecs, score = kept
            order = np.lexsort((vecs, -score, who))
            who, vecs, score = who[order], vecs[order], score[order]
            group = np.cumsum(np.append(True, (who[1:] != who[:-1]) | (score[1:] != score[:-1]))[: len(who)])
            rank = np.arange(len(who)) - np.searchsorted(group, group)
            place = np.arange(len(who)) - np.searchsorted(who, who)
            kth = place == k - 1
            least[who[kth]] = np.maximum(least[who[kth]], score[kth])
            some = (rank < k) & (score >= least[who] - 3e-6)
            kept = who[some], vecs[some], score[some]
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "vec_id", "score"])
