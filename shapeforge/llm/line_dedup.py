"""Line dedup with DataFrame functions only: drop every line whose normalised form is found in many documents.

Defined results: a null or empty text is one empty line; an empty key (white space only) is never counted while
``min_chars`` is 1 or more; repeated rows and rows that share a doc_id count as one document; null doc_ids count as one
document together; an empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, small_side

#: Stripped at both ends of a line: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line stripped of blanks, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hashes(text: Column, min_chars: int) -> Column:
    """Array with 128 bits of each line's key, as two longs, in order; null for keys that are too short to count.

    The keys are worked out in an array of their own, so each is worked out once.
    """
    keys = F.transform(split_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b"))))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashes of the line keys found in at least ``min_docs`` documents: ``a, b`` (128 bits)."""
    keys = F.array_distinct(F.filter(key_hashes(F.col(text_col), min_chars), lambda x: x.isNotNull()))
    per_doc = docs.select(F.col(id_col).alias("id"), F.explode(keys).alias("k")).select("id", "k.a", "k.b").distinct()
    return per_doc.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_text") -> DataFrame:
    """``docs`` with ``out`` (the text without frequent lines), ``n_lines`` and ``n_dropped``.

    Only (document, position, hash) triples are shuffled for the counts and the look-up; a row's text moves once, to
    meet the positions of its dropped lines, and the text is put together again by position.
    """
    frequent = small_side(cut(frequent_lines(docs, min_docs, min_chars, id_col, text_col)))
    mark = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    lines = docs.select(
        F.col(id_col).alias("i"),
        mark(F.col(text_col)).alias("t"),
        F.posexplode(key_hashes(F.col(text_col), min_chars)).alias("p", "k"),
    ).select("i", "t", "p", "k.a", "k.b")
    # rows with one doc_id and one text have the same lines, so their positions may be gathered together
    gone = lines.join(frequent, ["a", "b"], "left_semi").groupBy("i", "t").agg(F.collect_set("p").alias("gone"))
    row = free_name(docs.columns)
    field = lambda c: F.col(f"{row}.`{c}`")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    held = held.select(row, field(id_col).alias("i0"), mark(field(text_col)).alias("t0"))
    joined = held.join(gone, F.col("i0").eqNullSafe(F.col("i")) & (F.col("t0") == F.col("t")), "left")
    parts = split_lines(field(text_col))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")))
    text = F.when(F.col("gone").isNull(), F.coalesce(field(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(keep, lambda p: F.get(parts, p)), "\n")
    )
    new = {out, "n_lines", "n_dropped"}
    return joined.select(
        *[field(c).alias(c) for c in docs.columns if c not in new],
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        text.alias(out),
    )
