"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in tokens (by default runs of non-space characters, counted by the JVM).
Those longer than the largest permitted length are cut into full pieces and a rest. The pieces
(ids and lengths only, no text) are dealt at random into groups of about ``group_pieces``, and
each group is packed on its own: pieces go by decreasing size into the open bin with the least
room that still holds them; when none does, the bin size opens whose cost for each token it can
be expected to hold is least, given what is still to be packed; in the end every bin is downsized
to the smallest permitted length that holds its contents. The number of groups follows the pieces,
not the documents, and a group that got more than twice its share (rows that repeat an id are dealt
alike) is split by number, so none holds more than ``2 * group_pieces`` pieces whatever the source or
length distribution; only the last bins of a group are less full than they would be in one global packing.

Defined results: null, empty and blank texts have no tokens and get one row with ``bin_id`` null;
repeated and null ids are packed once for each row; ties go to the smaller id; an empty table gives no
rows; columns but doc_id and text are not read; very long texts are cut into pieces.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    capacities: tuple[int, ...] = (256, 512, 1024, 2048, 4096)
    #: Tokens that opening a bin costs beside its length.
    overhead: float = 16.0
    #: Extra cost of a token for each token of its bin's length (attention).
    attention: float = 1 / 65536
    group_pieces: int = 4096

    def cost(self, capacity: int) -> float:
        return self.overhead + capacity + self.attention * capacity * capacity


def pack_lengths(lengths: list[int], c: Config) -> tuple[list[int], list[int]]:
    """For lengths in decreasing order: the bin of each, and each bin's final capacity."""
    caps = sorted(c.capacities)
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[int] = []
    used: list[int] = []
    for n in lengths:
        left -= n
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [k for k in caps if k >= n]
            free = min(fits, key=lambda k: (c.cost(k) / (n + min(k - n, left)), k))
            b = len(used)
            used.append(0)
        used[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
        bins.append(b)
    return bins, [caps[bisect.bisect_left(caps, u)] for u in used]


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0))


def pack(docs: DataFrame, c: Config = Config(), tokens: Column | None = None) -> DataFrame:
    """One row for each piece of each document.

    Columns: doc_id, piece, first_token, n_tokens, bin_id, bin_capacity, bin_offset (where the piece starts in its bin).
    """
    top = max(c.capacities)
    sized = docs.select("doc_id", (token_count() if tokens is None else tokens).cast("int").alias("size"))
    pieces = sized.select(
        "doc_id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / top).cast("int") - 1, F.lit(0)))).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * top).alias("first_token"), F.least(F.col("size") - F.col("piece") * top, F.lit(top)).alias("n_tokens"))
    n = sized.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("size") / top), F.lit(1)).cast("long")), F.lit(0))).first()[0]
    groups = max(1, -(-n // c.group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", F.lit(11)), F.lit(groups)))
    place = F.row_number().over(Window.partitionBy("_group").orderBy("doc_id", "piece", "n_tokens")) - 1
    dealt = dealt.withColumn("_part", F.floor(place / (2 * c.group_pieces)))  # 0 but where many rows are dealt alike

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        full = g[g.n_tokens > 0]
        bins, caps = pack_lengths(full.n_tokens.tolist(), c)
        g["bin_id"], g["bin_capacity"], g["bin_offset"] = pd.array([pd.NA] * len(g), "Int64"), 0, 0
        if bins:
            b = pd.Series(bins, index=full.index)
            g.loc[full.index, "bin_id"] = b + (int(key[0]) << 32) + (int(key[1]) << 14)
            g.loc[full.index, "bin_capacity"] = b.map(caps.__getitem__)
            g.loc[full.index, "bin_offset"] = full.n_tokens.groupby(b).cumsum() - full.n_tokens
        return g[["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("_group", "_part").applyInPandas(
        run, f"doc_id {kind}, piece int, first_token int, n_tokens int, bin_id long, bin_capacity int, bin_offset int"
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
