"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are pre-aggregated to cells (source, language, topic); the cells' token weights are raked in turn to the three
target marginals; a document is then drawn with the probability that its cell's raked weight asks for.

No cell can give more tokens than it holds, so the weights are raked to the largest total at which every value of every
axis can meet its target (a little less, so that the passes get there), and never above a cell's tokens. Every probability
is then at most 1, and the drawn documents meet all three marginals up to sampling error, without weights.

Defined results: null source, language or topic are a category of their own ("(none)"); null and empty texts have no
tokens and are drawn with their cell's probability; a cell without tokens keeps probability 1; targets without cells are
left out and the others of that axis normed again; cells whose value has no target keep their weight; repeated rows of one
doc_id are drawn alike; ties can't arise (a draw depends on the id alone); texts of any length are counted whole; an empty
table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, free_name, small_side, store

NONE = "(none)"
AXES = ("source", "lang", "topic")
#: Targets, where none are given: present shares to this power, but no more than so many times the present share (a value that
#: is to grow much would thin all others, since nothing is drawn twice).
ALPHA, BOOST = 0.7, 1.5
#: Passes over the three axes, and the share of the largest feasible total that is aimed at.
ITERATIONS, SLACK = 8, 0.9


def token_count(text: Column) -> Column:
    """Words between blanks (space and the characters 9 to 13)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def topic_of(text: Column, lexicon: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A coarse topic: with a ``lexicon`` the topic whose words stand most often (ties to the first, none: ``other``); else a
    form of text: ``table``, ``figures``, ``note`` (under 100 words) or ``prose``."""
    t = F.coalesce(text, F.lit(""))
    if lexicon:
        hits = [F.struct(F.regexp_count(F.lower(t), F.lit(rf"\b(?:{'|'.join(words)})\b")).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(lexicon.items())]
        best = F.array_max(F.array(*hits))
        return F.when(best["n"] > 0, best["name"]).otherwise("other")
    size = F.greatest(F.char_length(t), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) * 1000 >= size * 20
    return (
        F.when(share("[|]"), "table").when(share("[0-9]"), "figures").when(token_count(text) < 100, "note").otherwise("prose")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(NONE))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _axes(docs: DataFrame, text_col: str, lexicon: Mapping[str, Sequence[str]] | None) -> list[Column]:
    """Source, language and topic of a document: the columns of the table, or what is derived from the text."""
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col(text_col), lexicon)
    return [F.coalesce(c.cast("string"), F.lit(NONE)) for c in (F.col("source"), F.col("lang"), topic)]


def cells_of(docs: DataFrame, text_col: str = "text", lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``source, lang, topic, tokens, docs`` - partial sums leave little to shuffle, whatever source is hot."""
    own = [c.alias(name) for c, name in zip(_axes(docs, text_col, lexicon), AXES, strict=True)]
    return docs.select(*own, token_count(F.col(text_col)).alias("n")).groupBy(*AXES).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _by_axis(cells: DataFrame, measure: str = "tokens") -> DataFrame:
    """``axis, value, n``: sums of a measure over the values of each axis."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES])
    return cells.select(F.explode(pairs).alias("x"), measure).groupBy("x.axis", "x.value").agg(F.sum(measure).alias("n"))


def tempered_targets(cells: DataFrame, alpha: float = ALPHA, boost: float = BOOST) -> DataFrame:
    """``axis, value, share``: each marginal's present token shares to the power ``alpha``, at most ``boost`` times the share."""
    held = _by_axis(cells).where("n > 0").withColumn("x", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    whole = held.groupBy("axis").agg(F.sum("n").alias("all_n"), F.sum("x").alias("all_x"))
    share = F.least(F.col("x") / F.col("all_x"), F.lit(float(boost)) * F.col("n") / F.col("all_n"))
    return held.join(whole, "axis").select("axis", "value", share.alias("share"))


def given_targets(spark, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    rows = [(a, v, float(s)) for a, by in targets.items() for v, s in by.items()]
    return spark.createDataFrame(rows, "axis string, value string, share double")


def aims(cells: DataFrame, targets: DataFrame, slack: float = SLACK) -> DataFrame:
    """``axis, value, share, aim``: the shares of present values, normed per axis, and the tokens they come to at the largest
    total that all of them can meet."""
    held = targets.where("share > 0").join(_by_axis(cells).where("n > 0"), ["axis", "value"])
    whole = held.groupBy("axis").agg(F.sum("share").alias("whole"))
    held = held.join(whole, "axis").select("axis", "value", "n", (F.col("share") / F.col("whole")).alias("share"))
    total = held.agg(F.min(F.col("n") / F.col("share")).alias("total"))
    return held.crossJoin(F.broadcast(total)).select("axis", "value", "share", (F.col("share") * F.col("total") * F.lit(float(slack))).alias("aim"))  # one row


def rake(cells: DataFrame, targets: DataFrame, iterations: int = ITERATIONS, slack: float = SLACK) -> DataFrame:
    """``cells`` with ``weight``, at most ``tokens``, whose marginals tend to the targets' shares.

    The table has one row per cell, never per document. A pass sums the weights per value of each axis in turn and writes one table.
    """
    wide, by = cells.withColumn("weight", F.col("tokens").cast("double")), cut(aims(cells, targets, slack))
    for axis in AXES:
        wide = wide.join(by.where(F.col("axis") == axis).select(F.col("value").alias(axis), F.col("aim").alias(f"to_{axis}")), axis, "left")
    wide, path = store(wide)
    for _ in range(iterations):
        for axis in AXES:
            now = wide.withColumn("now", F.sum("weight").over(Window.partitionBy(axis)))
            fit = F.least(F.col("weight") * F.col(f"to_{axis}") / F.col("now"), F.col("tokens").cast("double"))
            moved = F.when(F.col(f"to_{axis}").isNull() | (F.col("now") <= 0), F.col("weight")).otherwise(fit)
            wide = now.withColumn("weight", moved).drop("now")
        old, (wide, path) = path, store(wide)
        discard(cells.sparkSession, old)
    return wide.select(*AXES, "tokens", "docs", "weight")


def mix(docs: DataFrame, targets: DataFrame | None = None, alpha: float = ALPHA, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text", lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``docs`` with ``mix_topic, mix_tokens, mix_probability, mix_kept``.

    The probability is the raked weight over the tokens of the document's cell.
    """
    cells = cut(cells_of(docs, text_col, lexicon))
    raked = rake(cells, tempered_targets(cells, alpha) if targets is None else targets, iterations)
    want = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0))
    by_cell = small_side(cut(raked.select(*[F.col(c).alias(f"c_{c}") for c in AXES], want.alias("p"))))
    new = ("mix_topic", "mix_tokens", "mix_probability", "mix_kept")
    # a row travels as one struct, so its columns may have any names
    own, row = [c for c in docs.columns if c not in new], free_name(docs.columns)
    axes = [c.alias(f"c_{name}") for c, name in zip(_axes(docs, text_col, lexicon), AXES, strict=True)]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias(row), *axes, token_count(F.col(text_col)).alias("n"))
    joined = held.join(by_cell, [f"c_{c}" for c in AXES], "left")
    return joined.select(
        *[F.col(f"{row}.`{c}`").alias(c) for c in own], F.col("c_topic").alias("mix_topic"), F.col("n").alias("mix_tokens"),
        F.col("p").alias("mix_probability"), (uniform(F.col(f"{row}.`{id_col}`")) < F.col("p")).alias("mix_kept"),
    )
