"""Document fingerprints as Merkle trees, in DataFrame functions only.

A text is cut into sections (after blank lines), these into paragraphs (after line feeds) and these into leaves;
separators stay with what they end, so the parts concatenate to the text. Leaves end by content alone (after sentences,
words with certain last letters, certain characters in scripts and code without spaces), so an insertion changes only the
leaves that it touches, wherever it stands. A leaf's digest is the SHA-256 of its bytes, a paragraph's that of its leaves'
digests, a section's that of its paragraphs' and the root (the fingerprint) that of the sections'. Equal roots mean equal texts.

Likeness is counted on the trees' nodes: the Dice coefficient of their distinct leaf digests (by 64 bits of each), whose
counts the report returns. Where roots differ, differing branches locate the edit: ``edit_paragraph`` is the first
paragraph whose digest differs, and ``differing_paragraphs`` lists, of both trees, the paragraphs under sections that the
other tree doesn't have which the other's differing sections don't have either.

Null text is the empty text, whose one paragraph has no leaf. Two trees without leaves are alike (1.0). The next
document is the one with the next larger id; of several rows with one id the one with the least text hash
stands for them, and each takes the same next document. A null id counts as the least. Of a single document
the next is itself. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Workspace, ordered

SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)"
#: Of every 256 code points from U+3000 to the last Hangul syllable, 16 end a leaf.
WIDE = "".join(rf"\u{x:04x}-\u{x + 15:04x}" for x in range(0x3000, 0xD800, 0x100))
LEAF_END = rf"(?<=[.!?][\t-\r ]|[bdgkpwyß][\t-\r ]|[qzQZ7;}}]|[\u3000-\ud7ff&&[{WIDE}]])"
_LEAST = -(1 << 63)


def tree(text: Column) -> Column:
    """The leaves' digests: an array of sections, each an array of paragraphs, each an array of digests."""

    def paragraph(p: Column) -> Column:
        return F.transform(F.filter(F.split(p, LEAF_END), lambda x: x != ""), lambda x: F.sha2(x, 256))

    return F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), paragraph))


def paragraphs(leaves: Column) -> Column:
    """From ``tree``: an array of sections, each an array of its paragraphs' digests."""
    return F.transform(leaves, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ""), 256)))


def sections(inner: Column) -> Column:
    """From ``paragraphs``: the sections' digests."""
    return F.transform(inner, lambda s: F.sha2(F.array_join(s, ""), 256))


def root(inner: Column) -> Column:
    """From ``paragraphs``: the fingerprint."""
    return F.sha2(F.array_join(sections(inner), ""), 256)


def names(leaves: Column) -> Column:
    """64 bits of each distinct leaf digest of a tree."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(leaves)), lambda d: F.xxhash64(d)))


def likeness(a: Column, b: Column, both: Column) -> Column:
    """Dice coefficient from the numbers of distinct leaves of two trees and of those in both."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2.0 * both / (a + b))


def differing_paragraphs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """For rows with two texts, the (section, paragraph) places of each that the other doesn't have.

    Branches with equal digests are not descended into, wherever they stand. Adds ``side`` ("left" or "right"), ``section`` and
    ``paragraph`` (from 0); rows of equal texts vanish.
    """
    kept = pairs.columns
    for name, column in (("_a", left), ("_b", right)):
        pairs = pairs.withColumn(name, paragraphs(tree(F.coalesce(column, F.lit("")))))
    pairs = pairs.withColumns({"_x": sections(F.col("_a")), "_y": sections(F.col("_b"))})
    sides = None
    for side, own, digests, other, others in (("left", "_a", "_x", "_b", "_y"), ("right", "_b", "_y", "_a", "_x")):
        left_over = F.expr(f"flatten(filter({other}, (p, i) -> not array_contains({digests}, get({others}, i))))")
        rows = pairs.select(*kept, F.posexplode(F.arrays_zip(own, digests)).alias("section", "_s"), left_over.alias("_o"), F.col(others).alias("_d"))
        rows = rows.where(~F.array_contains("_d", F.col(f"_s.{digests}"))).select(*kept, "section", "_o", F.posexplode(f"_s.{own}").alias("paragraph", "_p"))
        rows = rows.where(~F.array_contains("_o", F.col("_p"))).select(*kept, F.lit(side).alias("side"), "section", "paragraph")
        sides = rows if sides is None else sides.union(rows)
    return sides


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited texts, and likenesses; one row for each row of ``docs``.

    The texts cross the network once, by id: the same exchange serves a document's own row and the sending of
    its head and the names of its leaves to the document before it.
    """
    space = Workspace(docs.sparkSession, "merkle")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = base.groupBy("k").agg(F.max(F.length("text")).cast("long").alias("n"))
    follow = ordered(ids, "k").select("k", "n", "following")
    first = ids.agg(F.min("k").alias("first"))  # one row
    sent = space.save(follow.crossJoin(F.broadcast(first)).select(F.coalesce("following", "first").alias("target"), F.col("k").alias("prev"), "n"), "next")
    received = base.join(sent.hint("merge"), base.k == sent.target).withColumn("_h", F.xxhash64("text"))
    chosen = received.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("_h", "text", "doc_id"))).where("_r = 1")  # all columns of base, so that both joins share its exchange
    head = chosen.select(F.col("prev").alias("k"), F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"), names(tree(F.col("text"))).alias("next_names"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))
    rows = base.join(head.hint("merge"), "k").select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_names")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_names", tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("new"))
    rows = rows.withColumns({"own_names": names(F.col("own")), "new_names": names(F.col("new")), "own": paragraphs(F.col("own")), "new": paragraphs(F.col("new"))})
    size = lambda x: F.size(x).cast("long")
    shared = lambda x: size(F.array_intersect("own_names", x))
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("own")).alias("fingerprint"),
        root(F.col("new")).alias("edited_fingerprint"),
        size("own_names").alias("n_leaves"),
        size("new_names").alias("n_edited_leaves"),
        shared("new_names").alias("n_shared_edited"),
        size("next_names").alias("n_next_leaves"),
        shared("next_names").alias("n_shared_next"),
        F.array_position(F.zip_with(F.flatten("own"), F.flatten("new"), lambda x, y: x.eqNullSafe(y)), False).alias("at"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("n_leaves"), F.col("n_edited_leaves"), F.col("n_shared_edited")).alias("near_edited"),
        likeness(F.col("n_leaves"), F.col("n_next_leaves"), F.col("n_shared_next")).alias("near_next"),
        "n_leaves",
        "n_edited_leaves",
        "n_shared_edited",
        "n_next_leaves",
        "n_shared_next",
        F.when(F.col("at") > 0, F.col("at") - 1).alias("edit_paragraph"),
    )


def _split_sql(text: str, pattern: str) -> str:
    """Cuts after every match; the mark between is a code point that no text has."""
    return f"string_split(regexp_replace({text}, '({pattern})', '\\1' || chr(1114111), 'g'), chr(1114111))"


def _tree_sql(text: str) -> str:
    wide = "".join(rf"\x{{{x:x}}}-\x{{{x + 15:x}}}" for x in range(0x3000, 0xD800, 0x100))
    leaf = rf"[.!?][\t-\r ]|[bdgkpwyß][\t-\r ]|[qzQZ7;}}]|[{wide}]"
    leaves = f"list_transform(list_filter({_split_sql('p', leaf)}, lambda x: x <> ''), lambda x: sha256(x))"
    return f"list_transform({_split_sql(text, chr(92) + 'n' + chr(92) + 'n+')}, lambda s: list_transform({_split_sql('s', chr(92) + 'n')}, lambda p: {leaves}))"


def oracle() -> str:
    """The report of ``documents`` in DuckDB SQL (ids without repeats)."""
    digest = "sha256(array_to_string({0}, ''))".format
    inner = lambda x: f"list_transform({x}, lambda s: list_transform(s, lambda p: {digest('p')}))"
    top = lambda x: digest(f"list_transform({x}, lambda s: {digest('s')})")
    count = lambda x: f"CAST(len({x}) AS BIGINT)"
    dice = lambda a, b, both: f"CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE 2.0 * {both} / ({a} + {b}) END"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS o FROM documents
), edits AS (
  SELECT doc_id, t, o, substr(t, 1, length(t) - length(t) // 4) || substr(o, 1, length(t) // 4) AS e FROM texts
), trees AS (
  SELECT doc_id, t, e, {_tree_sql("t")} AS tt, {_tree_sql("e")} AS te, {_tree_sql("o")} AS tn FROM edits
), nodes AS (
  SELECT doc_id, t, e, {inner("tt")} AS pt, {inner("te")} AS pe, list_distinct(flatten(flatten(tt))) AS a, list_distinct(flatten(flatten(te))) AS b, list_distinct(flatten(flatten(tn))) AS c FROM trees
), counts AS (
  SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, {top("pt")} AS fingerprint, {top("pe")} AS edited_fingerprint,
         {count("a")} AS n_leaves, {count("b")} AS n_edited_leaves, {count("list_intersect(a, b)")} AS n_shared_edited, {count("c")} AS n_next_leaves, {count("list_intersect(a, c)")} AS n_shared_next,
         flatten(pt) AS x, flatten(pe) AS y
  FROM nodes
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {dice("n_leaves", "n_edited_leaves", "n_shared_edited")} AS near_edited, {dice("n_leaves", "n_next_leaves", "n_shared_next")} AS near_next,
       n_leaves, n_edited_leaves, n_shared_edited, n_next_leaves, n_shared_next,
       nullif(list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS NOT DISTINCT FROM y[i]), false), 0) - 1 AS edit_paragraph
FROM counts
"""
