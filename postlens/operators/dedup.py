"""Union, keep-first deduplication, upsert and near-duplicate clusters."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name with the position of each frame as ``src_priority``."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("src_priority", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first by ``order`` (which must be total). Unlike ``dropDuplicates`` the choice is fixed."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly ``columns`` (name -> type), in order; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def enrich(old: DataFrame, new: DataFrame, key: str, plain: list[str], longest: list[str]) -> DataFrame:
    """New rows with old values where the new are blank; of ``longest`` columns the longer value wins. ``matched`` tells which had an old row."""
    o = old.select(F.col(key), F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in plain + longest])
    j = new.join(o, key, "left")
    long = lambda c: F.when(F.length(F.coalesce(F.col(f"_{c}"), F.lit(""))) > F.length(F.coalesce(F.col(c), F.lit(""))), F.col(f"_{c}")).otherwise(F.col(c))
    return j.select(key, *[F.coalesce(blank(F.col(c)), F.col(f"_{c}")).alias(c) for c in plain], *[long(c).alias(c) for c in longest], F.coalesce("_old", F.lit(False)).alias("matched"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Store after a batch, and what happened to each row. New non-blank values win."""
    o = old.select(F.col(key), F.lit(1).alias("_o"), *[F.col(c).alias(f"_{c}") for c in columns])
    n = new.select(F.col(key), F.lit(1).alias("_n"), *columns)
    j = o.join(n, key, "full_outer")
    action = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return j.select(key, *[F.coalesce(blank(F.col(c)), F.col(f"_{c}")).alias(c) for c in columns], action.alias("action"))


#: Lengths that text columns of the store are cut to.
LIMITS = {"title": 255, "company": 255, "description": 65535, "country": 100, "city": 100, "work_mode": 50, "employment_type": 50, "source_url": 1000}
_YES = ("1", "true", "yes", "on")


def ingest(store: DataFrame, batch: DataFrame, order: str, preserve: bool, day: str, source_default: str) -> DataFrame:
    """The store after a batch, with ``action`` (kept, created, updated); rows of the batch without an id are left out.

    The last row (by ``order``) of a source and id counts. Texts are trimmed and cut to ``LIMITS``; blank ones empty the column, or with
    ``preserve`` keep what the store has, where the longer description wins too. A posting is remote by its mode, scope or flag; with
    ``preserve`` a batch that tells none of these changes nothing. ``created_at`` is set once.
    """
    key = ["source", "source_job_id"]
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = batch.withColumns({"source": F.coalesce(F.nullif(text("source"), F.lit("")), F.lit(source_default)), "source_job_id": text("source_job_id")}).where("source_job_id <> ''")
    rows = keep_first(rows, key, [F.desc(order)])
    columns = [c for c in store.columns if c not in key]
    o = store.select(*key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = rows.withColumn("_new", F.lit(True)).join(o, key, "full_outer")
    known = F.coalesce(F.col("_old"), F.lit(False)) & F.lit(preserve)
    kept = lambda c: F.when(known, F.col(f"_{c}"))
    plain = lambda c: F.coalesce(F.nullif(F.substring(text(c), 1, LIMITS[c]), F.lit("")), kept(c))
    long = F.coalesce(F.col("description"), F.lit(""))
    long = F.when(known & (F.length(F.coalesce("_description", F.lit(""))) >= F.length(long)), F.col("_description")).otherwise(long)
    mode, scope, flag = F.lower(text("work_mode")), F.lower(text("remote_scope")), F.lower(text("remote_eligible"))
    told = ~mode.isin("", "unknown") | (scope != "") | (flag != "")
    remote = mode.isin("remote", "hybrid") | scope.isin("global", "africa-wide") | flag.isin(*_YES)
    merged_mode = F.when(known & mode.isin("", "unknown"), F.coalesce(F.nullif(F.lower(text("_work_mode")), F.lit("")), F.nullif(mode, F.lit("")), F.col("_work_mode"))).otherwise(F.nullif(mode, F.lit("")))
    new = {
        "title": F.coalesce(F.nullif(F.substring(text("title"), 1, LIMITS["title"]), F.lit("")), F.col("_title"), F.lit("")), "description": F.nullif(F.substring(long, 1, LIMITS["description"]), F.lit("")),
        "work_mode": F.substring(merged_mode, 1, LIMITS["work_mode"]), "remote": F.when(known & ~told, F.col("_remote")).otherwise(remote), "posted_at": F.coalesce("posted_at", kept("posted_at")),
        "expires_at": F.coalesce("expires_at", kept("expires_at")), "created_at": F.coalesce("_created_at", F.lit(day).cast("date")), **{c: plain(c) for c in ("company", "country", "city", "employment_type", "source_url")},
    }
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    return both.select(*key, *[F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(new[c]).alias(c) for c in columns], action.alias("action"))


def ingest_counts(ingested: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: created, updated, skipped (rows of the batch without an id) and processed."""
    n = lambda a: F.count_if(F.col("action") == a)
    skipped = batch.agg(F.count_if(F.trim(F.coalesce(F.col("source_job_id").cast("string"), F.lit(""))) == "").alias("skipped"))
    return ingested.agg(n("created").alias("created"), n("updated").alias("updated")).crossJoin(F.broadcast(skipped)).withColumn("total_processed", F.col("created") + F.col("updated"))


def new_links(linked: DataFrame, *found: DataFrame) -> DataFrame:
    """Distinct non-blank ``(job_id, skill)`` of all that was found, without those that are linked."""
    every = reduce(lambda a, b: a.unionByName(b), [f.select("job_id", F.trim("skill").alias("skill")) for f in found])
    return every.where("skill <> ''").distinct().join(linked.select("job_id", "skill"), ["job_id", "skill"], "left_anti")


PLACEHOLDERS = ("", "nan", "none", "n/a", "null", "-")


def clean(df: DataFrame) -> DataFrame:
    """Without empty columns, empty rows and copies; white space collapsed, placeholders null, columns named after a date as timestamps."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    full = df.select(*[c for c in df.columns if counts[c]]).dropna(how="all")
    texts = [f.name for f in full.schema.fields if f.dataType.simpleString() == "string"]
    for c in texts:
        tidy = F.trim(F.regexp_replace(c, r"\s+", " "))
        full = full.withColumn(c, F.when(~F.lower(tidy).isin(*PLACEHOLDERS), tidy))
    for c in [c for c in full.columns if "date" in c.lower()]:
        full = full.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
    return full.dropna(how="all").distinct()


def search(jobs: DataFrame, links: DataFrame, words=None, country=None, city=None, type=None, remote=None, open_since=None, skills=None) -> DataFrame:
    """Postings that meet every condition given; ``words`` in the title or company, ``skills`` any of them."""
    same = lambda c, v: F.lower(c) == v.lower()
    if words:
        jobs = jobs.where(F.lower("title").contains(words.lower()) | F.lower("company").contains(words.lower()))
    for c, v in (("country", country), ("city", city), ("type", type)):
        jobs = jobs if v is None else jobs.where(same(c, v))
    if remote is not None:
        jobs = jobs.where((F.lower("work_mode") == "remote") == remote)
    if open_since is not None:
        jobs = jobs.where(F.col("date_posted") >= open_since)
    return jobs if skills is None else jobs.join(links.where(F.col("skill").isin(skills)).select("job_id"), "job_id", "left_semi")


def edits(bits: dict[str, int], m: int, y: str, most: int) -> int:
    """Edit distance of ``y`` and the text of length ``m`` whose places of each character are ``bits``, or ``most + 1`` if it is larger.

    Myers' bit vectors in a band: rows farther than ``most`` below the diagonal cannot be on a path of ``most`` edits.
    The distance on the last diagonal never falls, so a pair ends as soon as it is too large there.
    """
    n = len(y)
    if abs(m - n) > most:
        return most + 1
    rows, mask, up, down = 0, 0, 0, 0
    for at in range(0, n, 64):
        wider = min(m, at + 64 + most + 1)
        up |= ((1 << wider) - 1) ^ mask
        rows, mask = wider, (1 << wider) - 1
        for c in y[at : at + 64]:
            eq = bits.get(c, 0) & mask
            xv = eq | down
            xh = ((((eq & up) + up) ^ up) | eq) & mask
            ph = ((down | (mask ^ (xh | up))) << 1 | 1) & mask
            mh = (up & xh) << 1 & mask
            up = mh | (mask ^ (xv | ph))
            down = ph & xv
        j = min(n, at + 64)
        low = (1 << max(0, min(rows, j + m - n))) - 1
        if j + m - n >= 0 and j + (up & low).bit_count() - (down & low).bit_count() > most:
            return most + 1
    return min(n + up.bit_count() - down.bit_count(), most + 1) if n else min(m, most + 1)


#: Letters of a segment and of a run, edits a segment counts for at most, places of runs in a table, and letters of texts that are held in numbers at once.
_SEGMENT, _RUN, _MOST, _PLACES, _LETTERS = 64, 4, 16, 4096, 1 << 22


def _bags(texts: list[str], columns: int = 64) -> np.ndarray:
    """How often each text has each letter; letters share ``columns`` by their codes."""
    out = np.zeros((len(texts), columns), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % columns, minlength=columns)
    return out


class Segments:
    """Segments of many texts, to bound their edit distances to another text from below, all at once.

    An edit touches at most ``_RUN`` of a segment's runs of so many letters; the others stand in the other text, moved as far as the segment as a
    whole and at most the segment's own edits further. A text of ``most`` edits and ``more`` letters more moves a segment by ``(more - most) / 2`` to
    ``(more + most) / 2``. So of the windows of that range the one with most of a segment's runs tells the least edits that it takes, up to ``_MOST``, and
    the sum over the segments is at most the distance. Runs share places by a hash, which can only lower the bound.
    """

    def __init__(self, texts: list[str]) -> None:
        """``texts`` should be in order of length, as neighbours that may move alike are looked up together."""
        self.sizes = np.array(list(map(len, texts)))
        self.count = max(1, -(-int(self.sizes.max()) // _SEGMENT))
        runs = np.full((len(texts), self.count * _SEGMENT), _PLACES, np.int64)  # past the end: a place that every window has
        for i, t in enumerate(texts):
            own = self.places(t)
            runs[i, : len(own)] = own
        inside = runs.reshape(len(texts), self.count, _SEGMENT)[:, :, : _SEGMENT - _RUN + 1]
        self.at = np.ascontiguousarray(inside.transpose(1, 2, 0)) + (np.arange(self.count) * (_PLACES + 1))[:, None, None]

    @staticmethod
    def places(text: str) -> np.ndarray:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(0, len(letters) - _RUN + 1)
        run = np.zeros(n, np.uint64)
        for k in range(_RUN):
            run = run * np.uint64(0x9E3779B97F4A7C15) + letters[k : k + n]
        return ((run * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 12)).astype(np.int64)

    def least(self, other: str, most: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of ``other`` and each text, right as long as that is at most ``most`` (of each text)."""
        more = len(other) - self.sizes
        first, last = (more - most) // 2 // _SEGMENT, (more + most + 1) // 2 // _SEGMENT
        # Byte j of a row's number for a place: a run of that place begins in window row + j; eight windows are looked up at once.
        base, span = int(first.min()), int((last - first).max()) + 1
        rows = self.count + int(first.max()) - base + -(-span // 8) * 8
        table = np.zeros((rows, _PLACES + 1, 8), np.uint8)
        flat, at = table.reshape(-1), self.places(other)
        begin = np.arange(len(at))
        top, low = (begin + _MOST) // _SEGMENT, -((2 * _SEGMENT - 1 - _RUN + _MOST - begin) // _SEGMENT)
        width = (_PLACES + 1) * 8
        for back in range((2 * _SEGMENT + 2 * _MOST) // _SEGMENT + 1):
            window = top - back
            for j in range(min(8, span)):
                row = window - j - base
                fit = (window >= low) & (row >= 0) & (row < rows)
                flat[row[fit] * width + at[fit] * 8 + j] = 1
        table[:, _PLACES] = 1
        numbers, out = table.view(np.uint64).reshape(-1), np.zeros(len(more), np.int64)
        bounds = np.flatnonzero(np.diff(first, prepend=first[0] - 1, append=first[-1] - 1))
        for i, k in zip(bounds, bounds[1:]):
            met = np.zeros((self.count, k - i), np.uint8)
            for eight in range(0, int((last[i:k] - first[i:k]).max()) + 1, 8):
                begin = (int(first[i]) - base + eight) * (_PLACES + 1)
                found = numbers[begin:].take(self.at[:, :, i:k]).sum(1, dtype=np.uint64)
                met = np.maximum(met, found.view(np.uint8).reshape(self.count, k - i, 8).max(2))
            missed = _SEGMENT - _RUN + 1 - met.astype(np.int64)
            out[i:k] = np.minimum(_MOST, -(-missed // _RUN)).sum(0)
        return out


def whole_pairs(df: DataFrame, key: str, text: str, block: list[Column], least: float, tile: int = 128) -> tuple[DataFrame, DataFrame]:
    """All pairs ``(a, b, similarity)`` of different texts of a block with edit similarity of ``least`` or more, and the links ``(a, b)`` of copies.

    Equal texts of a block are one row of the pairs (their smallest ``key``); the links tie the others to it. Texts of any
    length take part and every pair of near length is compared, since no equality of parts holds for all pairs at such a
    distance. Texts meet in tiles of about ``tile`` by ``tile``, by block and step of length: near lengths are at most one step apart.
    """
    rows = df.select(F.to_json(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(block)])).alias("_b"), F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null and _k is not null")
    one = rows.groupBy("_b", "_t").agg(F.min("_k").alias("_k"))
    copies = rows.join(one.withColumnRenamed("_k", "a"), ["_b", "_t"]).where("_k <> a").select("a", F.col("_k").alias("b")).distinct()

    step = F.floor(F.log(F.length("_t").cast("double")) / F.lit(math.log(1 / least) * 1.0001)).cast("int")
    one = one.where(F.length("_t") > 0).withColumn("_s", step)
    sizes = one.groupBy("_b", "_s").agg(F.ceil(F.count("*") / tile).cast("int").alias("_n"))
    next_ = sizes.select("_b", (F.col("_s") - 1).alias("_s"), F.col("_n").alias("_m"))
    own = one.join(sizes, ["_b", "_s"]).join(next_, ["_b", "_s"], "left").withColumn("_c", F.pmod(F.xxhash64("_k", "_t"), F.col("_n")).cast("int"))
    before = sizes.select("_b", (F.col("_s") + 1).alias("_s"), F.col("_n").alias("_p"))
    own = own.join(before, ["_b", "_s"], "left")
    # A tile is (block, step, part, step of the other side, its part); in a tile of one step the parts are in order.
    spot = lambda s, i, z, j: F.struct(s.cast("int").alias("s"), i.cast("int").alias("i"), z.cast("int").alias("z"), j.cast("int").alias("j"))
    s, c, parts = F.col("_s"), F.col("_c"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<s:int,i:int,z:int,j:int>>")
    same = F.transform(parts("_n"), lambda j: spot(s, F.least(c, j), s, F.greatest(c, j)))
    above = F.when(F.col("_m").isNotNull(), F.transform(parts("_m"), lambda j: spot(s, c, s + 1, j))).otherwise(none)
    below = F.when(F.col("_p").isNotNull(), F.transform(parts("_p"), lambda i: spot(s - 1, i, s, c))).otherwise(none)
    met = own.select("_b", "_s", "_c", "_k", "_t", F.explode(F.concat(same, above, below)).alias("_at"))

    def allowed(long):
        """Edits that leave texts of this length similar enough."""
        return np.floor((1 - least + 1e-4) * np.asarray(long)).astype(np.int64) + 1

    def compare(frame):
        import pandas as pd

        at = frame["_at"].iloc[0]
        side = [(r == (at["s"], at["i"]), r == (at["z"], at["j"])) for r in zip(frame["_s"], frame["_c"])]
        keys, texts = frame["_k"].tolist(), frame["_t"].tolist()
        left, right = [i for i, x in enumerate(side) if x[0]], [i for i, x in enumerate(side) if x[1]]
        alone = (at["s"], at["i"]) == (at["z"], at["j"])
        found = []
        # Pairs whose segments alone take too many edits are left out before the whole texts are compared.
        sizes = np.array(list(map(len, texts)))
        left = sorted(left, key=lambda i: (len(texts[i]), i))
        if alone:
            right = left
        bags = _bags(texts)
        possible = np.zeros((len(left), len(right)), bool)
        part = max(1, _LETTERS // max(1, int(sizes.max())))
        for begin in range(0, len(left), part):
            own = left[begin : begin + part]
            segments = Segments([texts[i] for i in own])
            for k, j in enumerate(right):
                most = allowed(np.maximum(sizes[own], sizes[j]))
                # Each edit moves at most one letter into a text and one out of it.
                moved = bags[own] - bags[j]
                fit = np.maximum(np.maximum(moved, 0).sum(1), np.maximum(-moved, 0).sum(1)) <= most
                if alone:
                    fit &= np.arange(begin, begin + len(own)) < k
                if fit.any():
                    fit &= segments.least(texts[j], most) <= most
                possible[begin : begin + len(own), k] = fit
        for r, i in enumerate(left):
            x, bits = texts[i], None
            for j in [j for k, j in enumerate(right) if possible[r, k]]:
                y = texts[j]
                long = max(len(x), len(y))
                if min(len(x), len(y)) < least * long:
                    continue
                if bits is None:
                    where: dict[str, bytearray] = {}
                    for k, ch in enumerate(x):
                        where.setdefault(ch, bytearray(len(x) // 8 + 1))[k >> 3] |= 1 << (k & 7)
                    bits = {ch: int.from_bytes(w, "little") for ch, w in where.items()}
                most = int(allowed(long))
                d = edits(bits, len(x), y, most)
                if d <= most:
                    found.append((min(keys[i], keys[j]), max(keys[i], keys[j]), d, long))
        return pd.DataFrame(found, columns=["a", "b", "d", "n"])

    kind = df.schema[key].dataType.simpleString()
    near = met.groupBy("_b", "_at").applyInPandas(compare, f"a {kind}, b {kind}, d int, n int")
    return near.select("a", "b", F.round(1 - F.col("d") / F.col("n"), 4).alias("similarity")).where(F.col("similarity") >= least), copies


def clusters(pairs: DataFrame, nodes: DataFrame, key: str, save) -> DataFrame:
    """``(key, cluster)``: every node with the smallest node it is linked to, directly or not.

    Labels spread along the links and jump over what they reach, so rounds grow with the logarithm of the
    longest chain; ``save(df)`` cuts the lineage of each round by writing it.
    """
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = save(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = save(nodes.select(F.col(key).alias("n"), F.col(key).alias("l")).distinct())
    while True:
        near = links.join(now, F.col("v") == F.col("n")).groupBy("u").agg(F.min("l").alias("m"))
        step = now.join(near, F.col("n") == F.col("u"), "left").select("n", F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = step.select(F.col("n").alias("_n"), F.col("l").alias("_l"))
        new = save(step.join(jump, F.col("l") == F.col("_n")).select("n", F.col("_l").alias("l")))
        moved = new.join(now.withColumnRenamed("l", "o"), "n").where("l <> o").limit(1).count()
        now = new
        if not moved:
            return now.select(F.col("n").alias(key), F.col("l").alias("cluster"))
