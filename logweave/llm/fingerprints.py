"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, with built-in functions only.

A text is cut, without loss, into sections (up to and with a run of two or more line ends),
these into paragraphs (a line with its line end), these into leaves (up to a sentence end, 96
characters at most). A leaf's node is the SHA-256 of "0" and its text, an inner node's
that of its level and its children's digests; the root is the fingerprint. Equal texts
have equal roots, and where roots differ only the branches whose digests differ need a look.
Likeness is the Jaccard similarity of the leaf digests.

Defined cases: null text counts as empty; two empty texts have likeness 1; texts of any
length are fingerprinted whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = r"(?s).+?(?:\n{2,}|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
LEAF = r"(?s).{1,96}?(?:[.!?]+[ \n\r\t]+|\z)|.{1,96}"
#: Rows of a range of ids; a window over texts holds one range at a time. Ids are cut at up to MAX_CUTS quantiles (they are
#: part of the plan), the ids between two cuts into up to MAX_PARTS equal widths: a million ranges, whose first ids are
#: broadcast (40 MB). Beyond a billion rows ranges grow, and sort with spilling.
RANGE_ROWS = 1024
MAX_CUTS = 8192
MAX_PARTS = 128


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _node(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")).cast("binary"), 256)


def leaf_tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests: array<array<array<string>>>."""
    leaf = lambda x: F.sha2(F.concat(F.lit("0"), x).cast("binary"), 256)
    return F.transform(_cut(F.coalesce(text, F.lit("")), SECTION), lambda s: F.transform(_cut(s, PARAGRAPH), lambda p: F.transform(_cut(p, LEAF), leaf)))


def section_digests(tree: Column) -> Column:
    return F.transform(tree, lambda s: _node("2", F.transform(s, lambda p: _node("1", p))))


def root(tree: Column) -> Column:
    """The fingerprint of a ``leaf_tree``."""
    return _node("3", section_digests(tree))


def leaves(tree: Column) -> Column:
    return F.flatten(F.flatten(tree))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of leaf digests; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def differing(tree: Column, other: Column) -> Column:
    """(section, paragraph) positions of ``tree`` under branches whose digests ``other`` lacks: where the edits are."""
    lacks = section_digests(other)
    paragraphs = F.flatten(F.transform(other, lambda s: F.transform(s, lambda p: _node("1", p))))
    at = F.transform(tree, lambda s, i: F.when(F.array_contains(lacks, _node("2", F.transform(s, lambda p: _node("1", p)))), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(s, lambda p, j: F.when(~F.array_contains(paragraphs, _node("1", p)), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())))
    return F.flatten(at)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text and next_text (of the next id; after the last, the first), without sorting all rows in one task.

    Ids are cut at quantiles, and between these evenly, into ranges. Each range's first row also goes, marked, to the
    range before it, so a window inside each range sees every successor and texts are dealt once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, least, most = docs.agg(F.count(F.lit(1)), F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    wanted = max(1, -(-n // range_rows))
    ranges, parts = min(MAX_CUTS, wanted), min(MAX_PARTS, -(-wanted // MAX_CUTS))
    if ranges > 1 and least is not None:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 20 * ranges))).first()[0]))
    else:
        cuts = []
    step = max(1, int(len(cuts) ** 0.5))
    coarse, groups = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    literal = lambda ids: "array(" + ", ".join("cast('-9223372036854775808' as bigint)" if i == -(2**63) else f"{i}L" for i in ids) + ")"

    def between(doc_id: Column) -> Column:
        """Number of cuts that are at most the id, through a two-level search; null ids come first."""
        c = F.size(F.filter(F.expr(literal(coarse)), lambda x: x <= doc_id))
        fine = F.element_at(F.expr(f"array({', '.join(literal([*g, *[2**63 - 1] * (step - len(g))]) for g in groups)})"), F.greatest(c, F.lit(1)))
        return F.when(doc_id.isNull() | (c == 0), 0).otherwise((c - 1) * step + F.size(F.filter(fine, lambda x: (x <= doc_id) & (x < 2**63 - 1))))

    def ranged(df: DataFrame) -> DataFrame:
        """Add ``range``, which never falls as the id grows."""
        if not cuts:
            return df.withColumn("range", F.lit(0))
        at = df.withColumn("range", between(F.col("doc_id")).cast("int"))
        if parts == 1:
            return at
        low, high = (F.element_at(F.expr(literal(x)), F.col("range") + 1).cast("double") for x in ([least, *cuts], [*cuts, most]))
        part = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts)
        return at.withColumn("range", F.col("range") * parts + F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)), F.lit(0)).cast("int"))

    firsts = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"))).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("first"))
    # At most one row a range. A range's predecessor is the nearest range below that has rows (ranges may be empty).
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    back = firsts.select(F.col("range").alias("r"), F.col("first.doc_id").alias("first_id"), F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    marked = ranged(rows).join(F.broadcast(back), F.col("range") == F.col("r"))  # at most MAX_CUTS * MAX_PARTS small rows
    ghost = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(F.struct(F.lit(0).alias("ghost"), F.col("range").alias("at")), F.struct(F.lit(1).alias("ghost"), F.col("before").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("ghost"), F.col("range").alias("at"))))
    dealt = marked.select("doc_id", "text", F.explode(ghost).alias("g")).select("doc_id", "text", "g.ghost", "g.at")
    w = Window.partitionBy("at").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(w)).where(F.col("ghost") == 0).select("doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (floor) of code points replaced by as many of the first of ``following``."""
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike the trees are."""
    rows = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    trees = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), leaf_tree(F.col("text")).alias("t"), leaf_tree(F.col("edited")).alias("e"), leaf_tree(F.col("next_text")).alias("x"))
    return trees.select("doc_id", "n_chars", "edited_sha256", root(F.col("t")).alias("fingerprint"), root(F.col("e")).alias("edited_fingerprint"), likeness(leaves(F.col("t")), leaves(F.col("e"))).alias("near_edited"), likeness(leaves(F.col("t")), leaves(F.col("x"))).alias("near_next"))
