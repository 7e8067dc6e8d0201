"""Merkle manifest of a table: a digest of every row, a root of every language and of the table, and a proof for each row.

A leaf is the SHA-256 of the row's fields, each framed by its length. The leaves of a language are
ranked by ``doc_id``; the octal digits of a rank are a leaf's way down from the root. Bounded blocks
of ``8^DIGITS`` ranks are rolled up inside one row: the lowest digit is grouped away first, the nodes
nest as structs in their parent, then the next digit, and so on, all after a single shuffle by block.
The blocks' roots are ranked already (by block number) and are rolled up the same way, tier by tier,
until each language has one; the languages' roots are one more such tree. Proofs go back down: a
transform gives each child the digests left and right of it, an explode makes it a row, and a tier's
rows meet the blocks below them by grouping (a row of each side), so no join takes part.

No group is larger than a block, whatever the share of a language. Ranks come from a range shuffle
(equal rows are told apart by a number, so that they spread too) and from a running count of its
partitions; the nested blocks are about 200 bytes a document and are written once.

Defined results: null fields are ``-``; null ids come first and are never tampered with; rows that
repeat an id follow each other by their leaf (equal leaves make equal trees in any order); a null
language is a language of its own, before the others; texts are hashed whole; an empty table has no
rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.shared import RANGE_ROWS, cut, ranked

#: Children of a node (three bits of the rank), and levels inside a block.
BITS = 3
FAN = 1 << BITS
DIGITS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` if null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang, leaf, seen``: ``seen`` is the leaf of the row as somebody hands it in, with ``tampered`` fields replaced."""
    own = docs.select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    leaf, seen = (digest(*[framed(c) for c in (fields | (other or {})).values()]) for other in ({}, tampered))
    return own.select("doc_id", "lang", leaf.alias("leaf"), seen.alias("seen"))


def height(total: Column) -> Column:
    """Levels above so many nodes."""
    levels = F.lit(0)
    for level in range(21):
        levels = levels + (total > F.lit(FAN**level)).cast("int")
    return levels


def roll_up(nodes: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """``keys, _rank, _total, digest`` -> a row for each block: ``keys, _block, _total, digest, kids`` (nested, down to ``item``)."""
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    digits = [F.shiftright("_rank", BITS * level).bitwiseAND(FAN - 1).cast("int").alias(f"_d{level}") for level in range(DIGITS)]
    held = nodes.select(*keys, F.shiftright("_rank", BITS * DIGITS).alias("_block"), "_total", *digits, "digest", item.alias("item")).repartition(parts, *keys, "_block")
    rolled = held.withColumn("_node", F.struct(F.col("_d0").alias("d"), "digest", "item"))
    for level in range(DIGITS):
        above = [f"_d{higher}" for higher in range(level + 1, DIGITS)]
        rolled = rolled.groupBy(*keys, "_block", "_total", *above).agg(F.array_sort(F.collect_list("_node")).alias("kids"))
        hashed = F.when(height(F.col("_total")) > level, F.sha2(F.concat_ws("", F.col("kids.digest")), 256)).otherwise(F.col("kids.digest")[0])
        rolled = rolled.withColumn("digest", hashed)
        if above:
            rolled = rolled.select(*keys, "_block", "_total", *above[1:], F.struct(F.col(above[0]).alias("d"), "digest", "kids").alias("_node"))
    return rolled


def _with_sides(kids: Column, columns: list[str]) -> Column:
    """The children with the digests on their left and right."""
    digests = F.col("kids.digest")

    def beside(kid: Column, at: Column) -> Column:
        left, right = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.lit(FAN))
        return F.struct(*[kid[c].alias(c) for c in columns], F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))

    return F.transform(kids, beside)


def hand_down(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks with the path of their root -> a row for each node in them: ``carried, path, digest, item``.

    ``path`` lists, from the node up, the digests on its left and on its right, concatenated.
    """
    rows = blocks.select(*carried, "_total", "path", "kids")
    for level in reversed(range(DIGITS)):
        below = ["digest", "kids" if level else "item"]
        rows = rows.select(*carried, "_total", "path", F.explode(_with_sides(F.col("kids"), below)).alias("kid"))
        step = F.array(F.struct(F.col("kid.left"), F.col("kid.right")))
        path = F.when(height(F.col("_total")) > level, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        rows = rows.select(*carried, "_total", path.alias("path"), *[F.col(f"kid.{c}").alias(c) for c in below])
    return rows.drop("_total")


def meet(blocks: DataFrame, paths: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Blocks with the one row of ``paths`` (``keys, _block, path, carried``) that leads to them."""
    both = blocks.drop("digest").unionByName(paths, allowMissingColumns=True)
    return both.groupBy(*keys, "_block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_total", "kids", "path", *carried)])


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, lang, leaf, seen, path, subroot, root`` for every row of ``docs``.

    ``path`` is an array of (left, right): the sibling digests of each level from the leaf to the root.
    """
    nodes = ranked(cut(leaves(docs, tampered), "merkle-leaves"), ["lang"], ["doc_id", "leaf"])
    item = F.struct("doc_id", "seen")
    most = -(-(nodes.agg(F.max("_total")).first()[0] or 1) // FAN**DIGITS)
    tiers = [cut(roll_up(nodes.withColumnRenamed("leaf", "digest"), ["lang"], item), "merkle-blocks")]
    while most > 1:
        above = tiers[-1].select("lang", F.col("_block").alias("_rank"), F.ceil(F.col("_total") / FAN**DIGITS).alias("_total"), "digest")
        tiers.append(cut(roll_up(above, ["lang"], F.struct(F.col("_rank").alias("block"))), "merkle-blocks"))
        most = -(-most // FAN**DIGITS)

    # The languages' roots: one tree, whose blocks are tiers of their own if there are very many languages.
    tops = tiers[-1].select(F.lit(0).alias("of"), "lang", F.col("digest").alias("subroot"))
    top = cut(ranked(tops, ["of"], ["lang"]), "merkle-languages")
    most = -(-(top.agg(F.max("_total")).first()[0] or 1) // FAN**DIGITS)
    upper = [cut(roll_up(top.withColumnRenamed("subroot", "digest"), ["of"], F.struct("lang")), "merkle-tops")]
    while most > 1:
        above = upper[-1].select("of", F.col("_block").alias("_rank"), F.ceil(F.col("_total") / FAN**DIGITS).alias("_total"), "digest")
        upper.append(cut(roll_up(above, ["of"], F.struct(F.col("_rank").alias("block"))), "merkle-tops"))
        most = -(-most // FAN**DIGITS)

    none = F.array().cast("array<struct<left: string, right: string>>")
    down = upper[-1].select("of", "_block", "_total", "kids", none.alias("path"), F.col("digest").alias("root"))
    for below in reversed(upper[:-1]):
        down = meet(below, hand_down(down, ["of", "root"]).select("of", F.col("item.block").alias("_block"), "path", "root"), ["of"], ["root"])
    down = hand_down(down, ["root"]).select(F.col("item.lang").alias("lang"), F.lit(0).cast("long").alias("_block"), "path", F.col("digest").alias("subroot"), "root")
    for below in reversed(tiers):
        down = hand_down(meet(below, down, ["lang"], ["subroot", "root"]), ["lang", "subroot", "root"])
        if below is not tiers[0]:
            down = down.select("lang", F.col("item.block").alias("_block"), "path", "subroot", "root")
    return down.select(F.col("item.doc_id").alias("doc_id"), "lang", F.col("digest").alias("leaf"), F.col("item.seen").alias("seen"), "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """The sibling digests in order, concatenated."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    told = proofs(docs, {"text": F.when(altered, lowered).otherwise(F.col("text"))})
    folded = told.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([b] || range(8), lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END) ORDER BY b) AS crc FROM range(256) r(b)
), marked AS (
    SELECT *, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), lambda h, c: xor(h // 256, crc[xor(h % 256, c) + 1])) AS crc_of
    FROM documents, crc_table
), fields AS (
    SELECT doc_id, lang,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') AS head,
        text, CASE WHEN xor(crc_of, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS handed
    FROM marked
), leaf AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(handed) || ':' || handed, '-')) AS seen FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), low AS (
    SELECT lang, 0 AS level, k, n, h FROM placed
    UNION ALL
    SELECT lang, level + 1, k // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY lang, level, k // 8, n
), subroots AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT 0 AS level, k, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, k // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY level, k // 8, n
), steps AS (
    SELECT a.doc_id, a.h AS leaf, a.seen, s.subroot, s.k AS lang_at, b.level,
        coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (WHERE b.k < a.k // (8 ** b.level)::bigint), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (WHERE b.k > a.k // (8 ** b.level)::bigint), '') AS r
    FROM placed a JOIN subroots s ON a.lang IS NOT DISTINCT FROM s.lang
    LEFT JOIN low b ON a.lang IS NOT DISTINCT FROM b.lang AND b.n > 1 AND b.k // 8 = a.k // (8 ** (b.level + 1))::bigint
    GROUP BY ALL
), top_steps AS (
    SELECT s.k AS lang_at, 100 + b.level AS level, coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (WHERE b.k < s.k // (8 ** b.level)::bigint), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.k) FILTER (WHERE b.k > s.k // (8 ** b.level)::bigint), '') AS r
    FROM subroots s JOIN high b ON b.n > 1 AND b.k // 8 = s.k // (8 ** (b.level + 1))::bigint GROUP BY ALL
), paths AS (
    SELECT doc_id, leaf, seen, subroot, lang_at, list({'l': l, 'r': r} ORDER BY level) FILTER (WHERE level IS NOT NULL) AS path FROM steps GROUP BY ALL
), whole AS (
    SELECT p.doc_id, p.leaf, p.seen, p.subroot, coalesce(p.path, []) || coalesce((SELECT list({'l': l, 'r': r} ORDER BY level) FROM top_steps t WHERE t.lang_at = p.lang_at), []) AS path FROM paths p
), told AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(list_reduce([''] || list_transform(path, lambda p: p.l || p.r), lambda a, b: a || b), '')) AS proof_sha256,
        list_reduce([{'l': seen, 'r': ''}] || path, lambda h, p: {'l': sha256(p.l || h.l || p.r), 'r': ''}).l AS folded_root
    FROM whole
)
SELECT *, folded_root = root AS verified FROM told
"""
