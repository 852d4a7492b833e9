"""Scalar functions on strings, paths and IRIs; all are Column expressions, so they stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BASE, TERMS

#: What counts as blank at the ends of a text.
_BLANK = r"[\s\x1c-\x1f\x85\xa0]"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"\A{_BLANK}+", ""), rf"{_BLANK}+\z", "")


def _identifier(c: Column) -> Column:
    name = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(F.length(name) == 0, None).when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def local_name_from_text(c: Column) -> Column:
    """STR1: a local name from any text; null where nothing is left after stripping."""
    return _identifier(strip(c))


def local_name_from_arcrole(c: Column) -> Column:
    """STR2: the last part of an arcrole URI as a local name."""
    last = F.regexp_replace(c, r"[/#]+\z", "")
    for sep in ("/", "#", ":"):
        last = F.substring_index(last, sep, -1)
    return _identifier(last)


def strip_type_suffix(c: Column) -> Column:
    """STR3: one trailing ``Type`` less."""
    return F.regexp_replace(c, r"Type\z", "")


def strip_prefix(c: Column) -> Column:
    """STR4: what follows the first colon; null for null and empty."""
    return F.when(F.length(c) > 0, F.regexp_replace(c, r"\A[^:]*:", ""))


def label_from_local_name(c: Column) -> Column:
    """STR5: underscores as spaces."""
    return F.translate(c, "_", " ")


def is_valid_local_name(c: Column) -> Column:
    """STR6: a letter or underscore, then letters, digits and underscores, and nothing else, not even a final newline."""
    return c.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")


def mint_term_iri(c: Column, namespace: str = TERMS) -> Column:
    """STR7: namespace + local name; null where the name is not valid."""
    return F.when(is_valid_local_name(c), F.concat(F.lit(namespace), c))


def _quoted(c: Column) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~/#``."""
    out = F.url_encode(F.replace(F.trim(strip(c)), F.lit(" "), F.lit("_")))
    for code, plain in (("%2F", "/"), ("%23", "#"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("+"), F.lit("%20"))


def mint_path_iri(*parts: Column, base: str = BASE) -> Column:
    """STR8: base + encoded parts joined with ``/``; blank parts are left out."""
    given = [F.when(F.length(strip(p)) > 0, _quoted(p)) for p in parts]
    return F.concat(F.lit(base), F.concat_ws("/", *given))


def with_fragment_separator(c: Column) -> Column:
    """STR9: ``#`` added unless the namespace ends in ``#`` or ``/``."""
    return F.when(c.rlike(r"[#/]\z"), c).otherwise(F.concat(c, F.lit("#")))


def documentation_text(texts: Column) -> Column:
    """STR10: stripped, non-empty texts of an ordered array joined by a blank line; null if none is left."""
    kept = F.filter(F.transform(texts, strip), lambda t: F.length(t) > 0)
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))


def local_name(c: Column) -> Column:
    """DOC5: the part after the last ``}``, else after the last ``:``, else the whole."""
    return F.when(c.contains("}"), F.substring_index(c, "}", -1)).otherwise(F.substring_index(c, ":", -1))


def normalize_path(c: Column) -> Column:
    """DOC6: steps as local names with an index; ``''`` for null, empty and step-less paths.

    Namespaces in braces are taken off before the path is cut, so those with slashes stay whole.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\{[^}]*\}", "")
    steps = F.filter(F.split(bare, "/", -1), lambda s: s != "")

    def step(s: Column) -> Column:
        name = F.substring_index(s, "[", 1)
        name = F.regexp_replace(name, r"\A[^:]*:", "")
        index = F.when(s.contains("["), F.regexp_replace(s, r"\A[^\[]*", "")).otherwise(F.lit("[1]"))
        return F.concat(name, index)

    return F.when(F.size(steps) == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.transform(steps, step), "/")))


def ancestor_paths(c: Column) -> Column:
    """DOC7: a normalised path and all its ancestors, the path itself first; empty for the empty path."""
    steps = F.filter(F.split(c, "/", -1), lambda s: s != "")
    n = F.size(steps)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    )


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the value ``a`` is less than, equal to or greater than ``b``: as numbers where both are numbers, else as dates and
    times (UTC where no zone is given); null where they can't be compared."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    exact = sign(a.try_cast("decimal(38,12)"), b.try_cast("decimal(38,12)"))
    number = a.try_cast("double").isNotNull() | b.try_cast("double").isNotNull()
    return F.coalesce(exact, sign(a.try_cast("double"), b.try_cast("double")), F.when(~number, sign(a.try_cast("timestamp"), b.try_cast("timestamp"))))
