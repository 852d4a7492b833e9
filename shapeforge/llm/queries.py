"""The registered query of each operator of this package, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, embedding_dedup, langid, licenses, line_dedup, mixing, order_minhash, periodic_runs, pieces, product_codes, quality, secrets, toxicity
from .common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (probability of good quality), kept."""
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten nearest of every vector whose vec_id is divisible by 100."""
    return additive.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("sampled"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = _table(spark, sf_dir, "documents")
    # two visits hold all rows together: the second one scans what the ledger of the first has not seen, and adds to it
    first = F.coalesce(F.xxhash64("doc_id") < 0, F.lit(False))
    ledger = cut(secrets.scan_unseen(docs.where(first)))
    new = cut(secrets.scan_unseen(docs.where(~first), ledger))
    found = secrets.findings_by_path(docs, ledger.unionByName(new), ["doc_id"])
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (false for a null id), lang_pred, score, rejected."""
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model, [F.col("doc_id"), held.alias("held_out")])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = pieces.encode(_table(spark, sf_dir, "documents"), decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept."""
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored, _ = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), fold=True)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    return product_codes.codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality_classifier, op2_additive_quantisation, op3_line_dedup, op4_source_mixing, op5_secret_scan, op6_language_id, op7_license_scan, op8_sentencepiece, op9_embedding_dedup, op10_order_minhash, op11_toxicity, op12_periodic_runs, op13_product_codes)
    return {f.__name__: f for f in made}


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _line_sql() -> str:
    key = f"translate(trim(line, {_BLANKS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}')"
    return f"""
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
    keyed AS (SELECT doc_id, line, pos, {key} AS k FROM lines),
    often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
    marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


def _mix_sql(alpha: float = mixing.ALPHA, iterations: int = mixing.ITERATIONS) -> str:
    words = f"len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+'))"
    ctes = [
        "d0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)",
        f"""d AS (SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, {words} AS n,
          CASE WHEN (length(t) - length(replace(t, '|', ''))) * 1000 >= greatest(length(t), 1) * 20 THEN 'table'
               WHEN len(regexp_extract_all(t, '[0-9]')) * 1000 >= greatest(length(t), 1) * 20 THEN 'figures'
               WHEN {words} < 100 THEN 'note' ELSE 'prose' END AS p FROM d0)""",
        "cells AS (SELECT s, l, p, sum(n)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for a in "slp":
        ctes.append(f"f{a} AS (SELECT {a}, sum(tokens) AS held, pow(sum(tokens), {alpha}) AS x FROM cells GROUP BY {a} HAVING sum(tokens) > 0)")
        ctes.append(f"b{a} AS (SELECT {a}, held, least(x / sum(x) OVER (), {mixing.BOOST} * held / sum(held) OVER ()) AS y FROM f{a})")
        ctes.append(f"t{a} AS (SELECT {a}, held, y / sum(y) OVER () AS share FROM b{a})")
    least = " UNION ALL ".join(f"SELECT held / share AS y FROM t{a}" for a in "slp")
    ctes.append(f"most AS (SELECT min(y) * {mixing.SLACK} AS total FROM ({least}))")
    ctes.append(
        "w0 AS (SELECT cells.*, tokens AS w, ts.share * total AS hs, tl.share * total AS hl, tp.share * total AS hp"
        " FROM cells CROSS JOIN most LEFT JOIN ts USING (s) LEFT JOIN tl USING (l) LEFT JOIN tp USING (p))"
    )
    k = 0
    for _ in range(iterations):
        for a in "slp":
            k += 1
            now = f"sum(w) OVER (PARTITION BY {a})"
            ctes.append(f"w{k} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN h{a} IS NULL OR {now} <= 0 THEN w ELSE least(w * h{a} / {now}, tokens) END AS w) FROM w{k - 1})")
    ctes.append(f"prob AS (SELECT s, l, p, CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END AS pr FROM w{k})")
    return f"""WITH {', '.join(ctes)}
    SELECT doc_id, source, lang, p AS topic, n AS n_tokens, round(pr, 6) AS probability,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '(none)')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < pr AS sampled
    FROM d JOIN prob USING (s, l, p)"""


def _secret_sql() -> str:
    """Matches are set between marks, the text is cut there, and lengths add up to places."""
    kinds = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(piece, '{p}', {r.group}))" if r.group else "length(piece)"
        kinds.append(f"""
        SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, place - length(piece) AS a, place AS e FROM (
          SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (
            SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
              SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps
              FROM documents WHERE regexp_matches(text, '{p}'))))
        WHERE i % 2 = 0 AND {size} >= {r.least}""")
    names = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)
    text = "kind || ':' || a || ':' || e"
    return f"""WITH found AS ({' UNION ALL '.join(kinds)})
    SELECT d.doc_id, {counts},
      sha256(coalesce(string_agg({text}, ',' ORDER BY a, rank) FILTER (kind IN ({names})), '')) AS base_sha256,
      coalesce(string_agg({text}, ',' ORDER BY a, rank), '') AS spans
    FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"""


def _vector_sql() -> str:
    return """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
    deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = e.vec_id AS kept
    FROM embeddings e JOIN comp ON comp.x = e.vec_id LEFT JOIN deg ON deg.x = e.vec_id"""


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, bit by bit: 4294967295, then each byte xor-ed in and shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384 * (h & 1)) END), 4294967295)"


def _runs_sql() -> str:
    """Equal words of a document at each lag, gathered to stretches of consecutive places."""
    least, times = periodic_runs.LEAST, periodic_runs.TIMES
    return f"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, {_crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
    f AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
    g AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM f),
    w AS MATERIALIZED (SELECT doc_id, n, i, ws[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM g)),
    same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * {times} <= x.n),
    part AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
    stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM part GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({least}, {times} * q)),
    runs AS MATERIALIZED (SELECT doc_id, s, m, min(q) AS q FROM stretch GROUP BY doc_id, s, m),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m::DOUBLE / q DESC, s, q) = 1),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
    kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
    SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli,
           sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _codes_sql() -> str:
    """Rounds written one after the other; squared distances of integers are exact in doubles."""
    parts, entries, scale = product_codes.PARTS, product_codes.ENTRIES, product_codes.SCALE
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r
          FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r AS e, v AS c FROM x WHERE r < {entries})",
    ]
    for k in range(product_codes.ROUNDS + 1):
        far = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        ctes.append(f"a{k} AS MATERIALIZED (SELECT r, p, min({{'d': ({far})::BIGINT, 'e': e}}) AS m FROM x JOIN c{k} USING (p) GROUP BY r, p)")
        if k < product_codes.ROUNDS:
            ctes.append(f"s{k} AS (SELECT p, e, k, sum(y::BIGINT) AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM a{k} JOIN x USING (r, p)) GROUP BY p, e, k)")
            ctes.append(f"n{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY k) AS c FROM s{k} GROUP BY p, e)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (p, e))")
    last = product_codes.ROUNDS
    ctes.append(f"told AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) AS h FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS k FROM c{last}))")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{last} GROUP BY r)")
    return f"""WITH {', '.join(ctes)}
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, told.h AS codebooks_sha256
    FROM coded JOIN kept USING (r), told"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": _line_sql(), "op4_source_mixing": _mix_sql(), "op5_secret_scan": _secret_sql(), "op9_embedding_dedup": _vector_sql(),
        "op12_periodic_runs": _runs_sql(), "op13_product_codes": _codes_sql(),
    }
