"""Queries of usage, association and lexicon statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.operators import association as A
from lexispan.operators import distances as D
from lexispan.operators import statistics as S
from lexispan.operators import usage as U
from lexispan.session import cut

SHARES = [0.5, 0.8, 0.9, 0.95, 0.99]
PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95]
LENGTH_EDGES, COUNT_EDGES = [4.0, 8.0, 16.0], [1.0, 3.0, 10.0]
CELL_A, CELL_B = "poetry", "sastra"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def valid_segments(spark: SparkSession, sf: str) -> DataFrame:
    """(segment_id, text, ids) of the latest row of each segment."""
    rows = table(spark, sf, "encoded_segments").where(F.col("segment_id").isNotNull())
    return rows.groupBy("segment_id").agg(F.max(F.struct("encoded_at", "text", "ids")).alias("r")).select("segment_id", F.col("r.text").alias("text"), F.col("r.ids").alias("ids"))


SEGMENTS = """segments AS (SELECT segment_id, text, ids FROM
  (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY encoded_at DESC NULLS LAST, text DESC NULLS LAST, ids DESC NULLS LAST) AS rn FROM encoded_segments WHERE segment_id IS NOT NULL) WHERE rn = 1)"""


def words(spark: SparkSession, sf: str, cells: tuple[str, ...] | None = None) -> DataFrame:
    """Words of all documents, or of those of some layers; a document without a layer is in the cell `none`."""
    rows = table(spark, sf, "documents")
    rows = rows if cells is None else rows.where(F.col("layer").isin(*cells))  # reaches the scan
    return U.word_rows(rows.select("doc_id", "text", F.coalesce("layer", F.lit("none")).alias("cell")), keep=("cell",))


def counted_words(spark: SparkSession, sf: str, cells: tuple[str, ...] | None = None) -> DataFrame:
    """(cell, form_key, surface, context, n): the words summed once and written; both axes of usage are read from there."""
    return cut(words(spark, sf, cells).groupBy("cell", "form_key", "surface", "context").agg(F.count(F.lit(1)).cast("double").alias("n")))


def lexicon(spark: SparkSession, sf: str, cell: str | None = None) -> DataFrame:
    return U.lexicon_of(U.usage_sums(words(spark, sf, None if cell is None else (cell,)), "surface"))


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, for comparison."""
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


WORDS = r"""
listed AS (SELECT doc_id, coalesce(layer, 'none') AS cell, list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, cell, i - 1 AS pos, lower(ws[i]) AS form_key, ws[i] AS surface,
  (CASE WHEN i > 1 THEN lower(ws[i - 1]) ELSE '<BOS>' END) || '>' || (CASE WHEN i < len(ws) THEN lower(ws[i + 1]) ELSE '<EOS>' END) AS context
  FROM listed, unnest(generate_series(1, len(ws))) AS u(i) WHERE len(ws) > 0),
lexicon AS (SELECT form_key, CAST(count(*) AS DOUBLE) AS expected_count FROM words GROUP BY form_key),
cells AS (SELECT cell, form_key, CAST(count(*) AS DOUBLE) AS expected_count FROM words GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY expected_count DESC, form_key) AS rank, sum(expected_count) OVER (ORDER BY expected_count DESC, form_key ROWS UNBOUNDED PRECEDING) AS cumulative FROM lexicon)
"""


def context_usage(spark, sf):
    return U.usage_sums(words(spark, sf), "context")


def surface_usage_upsert(spark, sf):
    rows = table(spark, sf, "surface_usage").where(F.col("form_key").isNotNull() & F.col("surface").isNotNull() & ~F.isnan("expected_mass"))
    return U.usage_sums(rows, "surface", mass="expected_mass", threshold=0.01)


def lexicon_finalize(spark, sf):
    return r6(U.smoothed(lexicon(spark, sf)).withColumn("probability", F.col("probability") * 1000))


def lexicon_export(spark, sf):
    rows = counted_words(spark, sf)
    surfaces, contexts = (U.usage_sums(rows, axis, mass="n") for axis in ("surface", "context"))
    out = U.lexicon_export(U.lexicon_of(surfaces), surfaces, contexts, threshold=2.0)
    return r6(out.withColumn("probability", F.col("probability") * 1000))


def top_lexicon(spark, sf):
    return r6(U.top_lexicon(U.smoothed(lexicon(spark, sf)), 20).withColumn("probability", F.col("probability") * 1000))


def low_count_lexicon(spark, sf):
    return U.top_lexicon(lexicon(spark, sf), 20, low=True)


def complexity_summary(spark, sf):
    return r6(U.complexity(lexicon(spark, sf)))


def thresholded_variants(spark, sf):
    return U.variant_counts(U.usage_sums(words(spark, sf), "context"), "contexts", threshold=2.0)


def _valid_usage(spark, sf):
    rows = table(spark, sf, "surface_usage").where(F.col("form_key").isNotNull() & F.col("surface").isNotNull() & F.col("expected_mass").isNotNull() & ~F.isnan("expected_mass"))
    return U.usage_sums(rows, "surface", mass="expected_mass")


_VALID_USAGE = """
usage AS (SELECT form_key, surface, sum(expected_mass) AS expected_mass FROM surface_usage
  WHERE form_key IS NOT NULL AND surface IS NOT NULL AND expected_mass IS NOT NULL AND NOT isnan(expected_mass) AND expected_mass > 0 GROUP BY ALL)
"""


def _concentration_sql(source: str, axis: str, keys: str) -> str:
    return f"""
sums AS (SELECT {keys}, count(*) AS rows, count(*) AS support, sum(expected_mass) AS mass, sum(expected_mass * ln(expected_mass)) AS mlogm,
  sum(expected_mass * expected_mass) AS m2, max(expected_mass) AS top1 FROM {source} GROUP BY {keys}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY expected_mass DESC, {axis} DESC) AS rank FROM {source}),
tops AS (SELECT {keys}, sum(expected_mass) AS topk FROM placed WHERE rank <= 2 GROUP BY {keys}),
metrics AS (SELECT *, greatest(0, ln(mass) - mlogm / mass) AS entropy, m2 / (mass * mass) AS herfindahl FROM sums JOIN tops USING ({keys})),
concentration AS (SELECT {keys}, rows, support, mass, top1 / mass AS top1_share, topk / mass AS topk_share, entropy,
  CASE WHEN support = 1 THEN 0 ELSE least(1, entropy / ln(support)) END AS normalized_entropy, greatest(1, exp(entropy)) AS effective_support, herfindahl,
  greatest(1, 1 / herfindahl) AS inverse_simpson FROM metrics)
"""


_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("mass", "top1_share", "topk_share", "entropy", "normalized_entropy", "effective_support", "herfindahl", "inverse_simpson"))


def association_metrics(spark, sf):
    return r6(A.concentration(_valid_usage(spark, sf), "surface"))


def association_top_items(spark, sf):
    return A.top_items(_valid_usage(spark, sf), "surface", k=3)


def context_association(spark, sf):
    return r6(A.concentration(U.usage_sums(words(spark, sf), "context"), "context"))


def _forms(rows):
    surfaces, contexts = (U.usage_sums(rows, axis, mass="n") for axis in ("surface", "context"))
    merged = A.form_table(U.lexicon_of(surfaces), A.concentration(surfaces, "surface"), A.concentration(contexts, "context"))
    return merged.withColumn("length", F.length("form_key").cast("long"))


def association_strata(spark, sf):
    return r6(A.strata(_forms(counted_words(spark, sf)), "context_top1_share", length="length", count="expected_count", mass="context_mass", length_edges=LENGTH_EDGES, count_edges=COUNT_EDGES))


def association_correlation(spark, sf):
    return r6(A.correlations(_forms(counted_words(spark, sf)), "expected_count", "context_top1_share", weight="context_mass"))


def _two(spark, sf):
    value = ("expected_count", "top1_share", "entropy", "effective_support")
    rows = counted_words(spark, sf, (CELL_A, CELL_B))
    side = lambda c: _forms(rows.where(F.col("cell") == c)).select("form_key", "expected_count", *(F.col(f"context_{m}").alias(m) for m in value[1:]))
    return A.membership(side(CELL_A), side(CELL_B), value=value)


def association_compare(spark, sf):
    return A.membership_counts(_two(spark, sf), count="expected_count")


def association_deltas(spark, sf):
    return r6(A.matched_deltas(_two(spark, sf), ("top1_share", "entropy", "effective_support"), count="expected_count"))


def association_diagnostics(spark, sf):
    return r6(A.specialized(_two(spark, sf), length=F.length("form_key").cast("long"), max_count=20.0, min_length=4, min_top1=0.3, max_support=6.0, min_delta=0.05, limit=25))


def _cell_contexts(cell: str, name: str) -> str:
    return f"""
{name}_usage AS (SELECT form_key, context, CAST(count(*) AS DOUBLE) AS m FROM words WHERE cell = '{cell}' GROUP BY ALL),
{name} AS (SELECT form_key, sum(m) AS expected_count, max(m) / sum(m) AS top1_share, greatest(0, ln(sum(m)) - sum(m * ln(m)) / sum(m)) AS entropy,
  greatest(1, exp(greatest(0, ln(sum(m)) - sum(m * ln(m)) / sum(m)))) AS effective_support FROM {name}_usage GROUP BY form_key)
"""


_TWO = f"WITH {WORDS}, {_cell_contexts(CELL_A, 'a')}, {_cell_contexts(CELL_B, 'b')}"
_FORMS = f"""WITH {WORDS}, context_use AS (SELECT form_key, context, CAST(count(*) AS DOUBLE) AS m FROM words GROUP BY ALL),
forms AS (SELECT form_key, sum(m) AS expected_count, sum(m) AS mass, max(m) / sum(m) AS v, length(form_key) AS length FROM context_use GROUP BY form_key)"""


def _bin_sql(column: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} <= {e:g} THEN '<={e:g}'" for e in edges) + f" ELSE '>{edges[-1]:g}' END"


_LENGTHS, _COUNTS = (", ".join(f"('{x}')" for x in A.bins(e)) for e in (LENGTH_EDGES, COUNT_EDGES))
_MEANS = "count(*) AS forms, count(v) AS eligible_forms, round(avg(v), 6) AS type_mean, round(sum(expected_count * v) / sum(expected_count), 6) AS training_mean, round(sum(mass * v) / sum(mass), 6) AS association_mean"


def lexicon_diversity(spark, sf):
    return r6(S.diversity(lexicon(spark, sf)))


def mass_support(spark, sf):
    return S.mass_support(lexicon(spark, sf), SHARES)


def top_mass(spark, sf):
    return r6(S.top_mass(lexicon(spark, sf), [10, 100, 1000]))


def log2_histogram_quantiles(spark, sf):
    documents = table(spark, sf, "documents").where(F.col("text").isNotNull())
    rows = documents.select(F.coalesce("layer", F.lit("none")).alias("cell"), F.length("text").alias("chars"))
    return r6(S.histogram_quantiles(rows, "chars", PROBABILITIES, by=("cell",)))


def weighted_length_quantile(spark, sf):
    return S.weighted_quantiles(lexicon(spark, sf).withColumn("length", F.length("form_key")), "length", "expected_count", PROBABILITIES)


def edge_tail_share(spark, sf):
    return r6(S.edge_tail_share(lexicon(spark, sf), "expected_count", [0.001, 0.01, 0.1]))


def long_low_reuse_grid(spark, sf):
    rows = counted_words(spark, sf)
    surfaces, contexts = (U.usage_sums(rows, axis, mass="n") for axis in ("surface", "context"))
    forms = U.lexicon_export(U.lexicon_of(surfaces), surfaces, contexts).withColumn("length", F.length("form_key"))
    return r6(S.reuse_grid(forms, lengths=[8, 16], reuse=[2, 5], length="length", axes={"contexts": "number_of_contexts", "surface_variants": "number_of_surface_variants"}))


def lexical_mass_summary(spark, sf):
    return r6(S.mass_summary(lexicon(spark, sf), low_count=1.0, shares=[0.5, 0.9]))


def usage_rank_summary(spark, sf):
    rows = table(spark, sf, "surface_usage").where(F.col("form_key").isNotNull() & (F.col("expected_mass") > 0) & ~F.isnan("expected_mass"))
    return r6(S.usage_summary(rows.groupBy("form_key").agg(F.sum("expected_mass").alias("mass")), "form_key", "mass"))


def pass_dynamics(spark, sf):
    rows = table(spark, sf, "surface_usage").where(F.col("expected_mass").isNotNull() & ~F.isnan("expected_mass") & F.col("exported_at").isNotNull())
    metric = F.when(F.length("surface") > 8, "long").otherwise("short")
    days = rows.groupBy(metric.alias("metric"), F.to_date("exported_at").cast("string").alias("day")).agg(F.sum("expected_mass").alias("value"))
    return r6(S.deltas(days, metric="metric", order="day", value="value"))


def runtime_rollup(spark, sf):
    rows = valid_segments(spark, sf).where(F.col("text").isNotNull())
    wide = rows.groupBy(F.when(F.col("text").rlike("[ऀ-ॿ]"), "devanagari").otherwise("iast").alias("script")).agg(
        F.sum(F.length("text")).cast("double").alias("characters"), F.count(F.lit(1)).cast("double").alias("segments"), F.countDistinct(F.substring_index("segment_id", ":", 1)).cast("double").alias("documents")
    )
    return r6(S.rollup(wide, by=["script"], totals=["characters", "segments", "documents"], ratios={"characters_per_segment": ("characters", "segments"), "segments_per_document": ("segments", "documents")}))


def boundary_entropy(spark, sf):
    """How surely a letter ends a word: of each letter the share of its uses that stand at a word's end."""
    each = words(spark, sf).select(F.posexplode(F.split("form_key", "")).alias("at", "letter"), (F.length("form_key") - 1).alias("last")).where("letter <> ''")
    rows = each.groupBy("letter").agg(F.count(F.lit(1)).alias("uses"), (F.count_if(F.col("at") == F.col("last")) / F.count(F.lit(1))).alias("p"))
    return r6(rows.select("letter", "uses", "p", S.binary_entropy(F.col("p")).alias("entropy")))


def _ab(spark, sf):
    return lexicon(spark, sf, CELL_A), lexicon(spark, sf, CELL_B)


def pair_jaccard_topk(spark, sf):
    return r6(D.top_jaccard(*_ab(spark, sf), [10, 100, 1000]))


def pair_l1_spearman(spark, sf):
    return r6(D.top_distance(*_ab(spark, sf), 1000))


def total_variation(spark, sf):
    return r6(D.total_variation(*_ab(spark, sf), "form_key", "expected_count"))


def jensen_shannon(spark, sf):
    return r6(D.jensen_shannon(*_ab(spark, sf), "form_key", "expected_count"))


def scalar_compare(spark, sf):
    a, b = (table(spark, sf, "documents").where(F.col("layer") == s).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias(n)) for s, n in ((CELL_A, "a"), (CELL_B, "b")))
    both = a.join(b, "source", "full").fillna(0.0, ["a", "b"])
    return r6(both.select("source", "a", "b", *D.scalar_comparison(F.col("a"), F.col("b"))))


def minhash_bottomk(spark, sf):
    a, b = (D.bottom_k(x, "form_key", 2048) for x in _ab(spark, sf))
    return r6(D.minhash_jaccard(a, b, 2048))


def hash_reservoir(spark, sf):
    return D.hash_reservoir(table(spark, sf, "canonical_manifest").where(F.col("document_id").isNotNull()).select("document_id").distinct(), "document_id", 12)


def top_reservoir(spark, sf):
    rows = lexicon(spark, sf).withColumn("category", F.when(F.length("form_key") > 8, "long").otherwise("short"))
    return D.top_reservoir(rows, "category", "expected_count", "form_key", 12).select("category", "form_key", "expected_count", "rank")


QUERIES = [
    context_usage, surface_usage_upsert, lexicon_finalize, lexicon_export, top_lexicon, low_count_lexicon, complexity_summary, thresholded_variants,
    association_metrics, association_top_items, context_association, association_strata, association_correlation, association_compare, association_deltas,
    association_diagnostics, lexicon_diversity, mass_support, top_mass, log2_histogram_quantiles, weighted_length_quantile, edge_tail_share,
    long_low_reuse_grid, lexical_mass_summary, usage_rank_summary, pass_dynamics, runtime_rollup, boundary_entropy, pair_jaccard_topk, pair_l1_spearman,
    total_variation, jensen_shannon, scalar_compare, minhash_bottomk, hash_reservoir, top_reservoir,
]

_LEX = f"WITH {WORDS}"
_PAIR = f"""WITH {WORDS}, a AS (SELECT form_key, expected_count, expected_count / sum(expected_count) OVER () AS share, row_number() OVER (ORDER BY expected_count DESC, form_key) AS rank FROM cells WHERE cell = '{CELL_A}'),
b AS (SELECT form_key, expected_count, expected_count / sum(expected_count) OVER () AS share, row_number() OVER (ORDER BY expected_count DESC, form_key) AS rank FROM cells WHERE cell = '{CELL_B}')"""
_BUCKET = "CASE WHEN v = 0 THEN -100000 ELSE CAST(floor(log2(v) * 8) AS BIGINT) END"
SQL = {
    "context_usage": f"{_LEX} SELECT form_key, context, CAST(count(*) AS DOUBLE) AS expected_mass FROM words GROUP BY ALL",
    "surface_usage_upsert": """SELECT form_key, surface, sum(expected_mass) AS expected_mass FROM surface_usage
WHERE form_key IS NOT NULL AND surface IS NOT NULL AND NOT isnan(expected_mass) AND expected_mass > 0.01 GROUP BY ALL""",
    "lexicon_finalize": f"{_LEX} SELECT form_key, expected_count, round(1000 * (expected_count + 0.1) / (sum(expected_count) OVER () + 0.1 * count(*) OVER ()), 6) AS probability FROM lexicon",
    "lexicon_export": f"""{_LEX},
s AS (SELECT form_key, count(*) AS n FROM (SELECT form_key, surface FROM words GROUP BY ALL HAVING count(*) >= 2) GROUP BY form_key),
c AS (SELECT form_key, count(*) AS n FROM (SELECT form_key, context FROM words GROUP BY ALL HAVING count(*) >= 2) GROUP BY form_key)
SELECT form_key, expected_count, round(1000 * (expected_count + 0.1) / (sum(expected_count) OVER () + 0.1 * count(*) OVER ()), 6) AS probability,
  coalesce(s.n, 0) AS number_of_surface_variants, coalesce(c.n, 0) AS number_of_contexts FROM lexicon LEFT JOIN s USING (form_key) LEFT JOIN c USING (form_key)""",
    "top_lexicon": f"{_LEX} SELECT form_key, expected_count, round(1000 * (expected_count + 0.1) / (sum(expected_count) OVER () + 0.1 * count(*) OVER ()), 6) AS probability FROM lexicon ORDER BY expected_count DESC, form_key LIMIT 20",
    "low_count_lexicon": f"{_LEX} SELECT form_key, expected_count FROM lexicon ORDER BY expected_count, form_key LIMIT 20",
    "complexity_summary": f"{_LEX} SELECT count(*) AS types, sum(expected_count) AS mass, count(*) FILTER (WHERE expected_count <= 1) AS low_count_types, round(0.5 * sum(ln(1 + expected_count)), 6) AS complexity FROM lexicon",
    "thresholded_variants": f"{_LEX} SELECT form_key, count(*) AS contexts FROM (SELECT form_key, context FROM words GROUP BY ALL HAVING count(*) >= 2) GROUP BY form_key",
    "association_metrics": f"WITH {_VALID_USAGE}, {_concentration_sql('usage', 'surface', 'form_key')} SELECT form_key, rows, support, {_R6} FROM concentration",
    "association_top_items": f"""WITH {_VALID_USAGE} SELECT form_key, surface, expected_mass, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY form_key ORDER BY expected_mass DESC, surface DESC) AS rank FROM usage) WHERE rank <= 3""",
    "context_association": f"""{_LEX}, usage AS (SELECT form_key, context, CAST(count(*) AS DOUBLE) AS expected_mass FROM words GROUP BY ALL), {_concentration_sql('usage', 'context', 'form_key')}
SELECT form_key, rows, support, {_R6} FROM concentration""",
    "association_strata": f"""{_FORMS}, binned AS (SELECT *, {_bin_sql("length", LENGTH_EDGES)} AS lb, {_bin_sql("expected_count", COUNT_EDGES)} AS cb FROM forms),
lengths(lb) AS (VALUES {_LENGTHS}), counts(cb) AS (VALUES {_COUNTS})
SELECT 'length_count' AS stratum, l.lb AS length_bin, c.cb AS count_bin, coalesce(forms, 0) AS forms, coalesce(eligible_forms, 0) AS eligible_forms, type_mean, training_mean, association_mean
  FROM lengths l CROSS JOIN counts c LEFT JOIN (SELECT lb, cb, {_MEANS} FROM binned GROUP BY ALL) x ON x.lb = l.lb AND x.cb = c.cb
UNION ALL SELECT 'length', l.lb, NULL, coalesce(forms, 0), coalesce(eligible_forms, 0), type_mean, training_mean, association_mean FROM lengths l LEFT JOIN (SELECT lb, {_MEANS} FROM binned GROUP BY ALL) x ON x.lb = l.lb
UNION ALL SELECT 'count', NULL, c.cb, coalesce(forms, 0), coalesce(eligible_forms, 0), type_mean, training_mean, association_mean FROM counts c LEFT JOIN (SELECT cb, {_MEANS} FROM binned GROUP BY ALL) x ON x.cb = c.cb
UNION ALL SELECT 'all', NULL, NULL, forms, eligible_forms, type_mean, training_mean, association_mean FROM (SELECT {_MEANS} FROM binned)""",
    "association_correlation": f"""{_FORMS}, m AS (SELECT sum(mass * expected_count) / sum(mass) AS wx, sum(mass * v) / sum(mass) AS wy FROM forms)
SELECT count(*) AS rows, round(corr(expected_count, v), 6) AS pearson,
  round(sum(mass * (expected_count - wx) * (v - wy)) / sqrt(sum(mass * (expected_count - wx) * (expected_count - wx)) * sum(mass * (v - wy) * (v - wy))), 6) AS weighted_pearson FROM forms, m""",
    "association_compare": f"""{_TWO} SELECT CASE WHEN a.form_key IS NULL THEN 'cell_b_only' WHEN b.form_key IS NULL THEN 'cell_a_only' ELSE 'shared' END AS membership,
  count(*) AS forms, coalesce(sum(a.expected_count), 0) AS a_mass, coalesce(sum(b.expected_count), 0) AS b_mass FROM a FULL JOIN b ON a.form_key = b.form_key GROUP BY 1""",
    "association_deltas": _TWO + ", m AS (SELECT a.expected_count AS wa, b.expected_count AS wb, unnest([{'metric': 'top1_share', 'delta': b.top1_share - a.top1_share}, {'metric': 'entropy', 'delta': b.entropy - a.entropy}, {'metric': 'effective_support', 'delta': b.effective_support - a.effective_support}]) AS x FROM a JOIN b USING (form_key)) "
    "SELECT x.metric AS metric, count(*) AS matched_forms, round(avg(x.delta), 6) AS type_mean, round(sum(wa * x.delta) / sum(wa), 6) AS a_weighted_mean, round(sum(wb * x.delta) / sum(wb), 6) AS b_weighted_mean FROM m GROUP BY 1",
    "association_diagnostics": f"""{_TWO}, base AS (SELECT a.form_key, a.expected_count AS a_expected_count, a.top1_share AS a_top1_share, a.effective_support AS a_effective_support, b.top1_share AS bt, b.form_key AS bk, length(a.form_key) AS phoneme_length
  FROM a LEFT JOIN b USING (form_key) WHERE length(a.form_key) >= 4 AND a.expected_count <= 20 AND a.top1_share >= 0.3 AND a.effective_support <= 6),
scored AS (SELECT *, CASE WHEN bk IS NULL THEN 'target_only_specialized' WHEN a_top1_share - bt >= 0.05 THEN 'shared_more_specialized' END AS category, CASE WHEN bk IS NULL THEN a_top1_share ELSE a_top1_share - bt END AS s FROM base)
SELECT * FROM (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY s DESC, a_top1_share DESC, a_effective_support, phoneme_length DESC, a_expected_count, form_key DESC) AS INTEGER) AS selection_rank,
  form_key, round(s, 6) AS selection_score, phoneme_length, a_expected_count, round(a_top1_share, 6) AS a_top1_share, round(a_effective_support, 6) AS a_effective_support FROM scored WHERE category IS NOT NULL) WHERE selection_rank <= 25""",
    "lexicon_diversity": f"""{_LEX}, s AS (SELECT count(*) AS n, sum(expected_count) AS m, sum(expected_count * ln(expected_count)) AS l, sum(expected_count * expected_count) AS q, sum(rank * expected_count) AS r FROM ranked)
SELECT n AS types, m AS mass, round(ln(m) - l / m, 6) AS entropy, round(exp(ln(m) - l / m), 6) AS exp_entropy, round(m * m / q, 6) AS inverse_simpson, round((n + 1) / n - 2 * r / (n * m), 6) AS gini FROM s""",
    "mass_support": f"""{_LEX}, t AS (SELECT sum(expected_count) AS total, count(*) AS n FROM lexicon), shares(share) AS (VALUES {", ".join(f"(CAST({s} AS DOUBLE))" for s in SHARES)})
SELECT share, coalesce(min(rank) FILTER (WHERE cumulative >= share * total), max(n)) AS types FROM ranked, t, shares GROUP BY share""",
    "top_mass": f"{_LEX}, k(k) AS (VALUES (10), (100), (1000)) SELECT CAST(k AS BIGINT) AS k, sum(expected_count) FILTER (WHERE rank <= k) AS mass, round(sum(expected_count) FILTER (WHERE rank <= k) / sum(expected_count), 6) AS share FROM ranked, k GROUP BY k",
    "log2_histogram_quantiles": f"""WITH rows AS (SELECT coalesce(layer, 'none') AS cell, length(text) AS v FROM documents WHERE text IS NOT NULL),
h AS (SELECT cell, {_BUCKET} AS b, count(*) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM rows GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY cell ORDER BY b) AS seen, sum(n) OVER (PARTITION BY cell) AS total, CASE WHEN b = -100000 THEN 0 ELSE pow(2.0, (b + 0.5) / 8) END AS mid FROM h)
SELECT cell, CAST(sum(n) AS BIGINT) AS count, round(sum(s) / sum(n), 6) AS mean, CAST(min(lo) AS DOUBLE) AS minimum, CAST(max(hi) AS DOUBLE) AS maximum,
  {", ".join(f"round(min(mid) FILTER (WHERE seen >= greatest(1, ceil({p} * total))), 6) AS q{round(p * 100):02d}" for p in PROBABILITIES)} FROM p GROUP BY cell""",
    "weighted_length_quantile": f"""{_LEX}, g AS (SELECT length(form_key) AS v, sum(expected_count) AS w FROM lexicon GROUP BY 1), p AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM g)
SELECT {", ".join(f"CAST(min(v) FILTER (WHERE c >= {p} * t) AS DOUBLE) AS q{round(p * 100):02d}" for p in PROBABILITIES)} FROM p""",
    "edge_tail_share": f"""{_LEX}, r AS (SELECT expected_count AS v FROM lexicon), h AS (SELECT {_BUCKET} AS b, count(*) AS n, sum(v) AS m FROM r GROUP BY 1),
p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS rows, sum(m) OVER () AS total FROM h),
f(fraction) AS (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)))
SELECT fraction, round(sum(m * least(n, greatest(0, greatest(1, ceil(rows * fraction)) - before)) / n) / max(total), 6) AS share FROM p, f GROUP BY fraction""",
    "long_low_reuse_grid": f"""{_LEX}, f AS (SELECT form_key, count(*) AS c, length(form_key) AS l, count(DISTINCT context) AS contexts, count(DISTINCT surface) AS surface_variants FROM words GROUP BY form_key),
u AS (SELECT *, unnest(['contexts', 'surface_variants']) AS axis, unnest([contexts, surface_variants]) AS used FROM f),
g AS (SELECT 'long' AS family, CAST(t AS BIGINT) AS length_threshold, CAST(NULL AS VARCHAR) AS axis, CAST(NULL AS BIGINT) AS reuse_threshold, count(*) FILTER (WHERE l >= t) AS types, coalesce(sum(c) FILTER (WHERE l >= t), 0) AS mass, count(*) AS n, sum(c) AS m FROM f, (VALUES (8), (16)) AS x(t) GROUP BY t
UNION ALL SELECT 'low_reuse', NULL, axis, r, count(*) FILTER (WHERE used < r), coalesce(sum(c) FILTER (WHERE used < r), 0), count(*), sum(c) FROM u, (VALUES (2), (5)) AS y(r) GROUP BY axis, r
UNION ALL SELECT 'long_low_reuse', t, axis, r, count(*) FILTER (WHERE l >= t AND used < r), coalesce(sum(c) FILTER (WHERE l >= t AND used < r), 0), count(*), sum(c) FROM u, (VALUES (8), (16)) AS x(t), (VALUES (2), (5)) AS y(r) GROUP BY t, axis, r)
SELECT family, length_threshold, axis, reuse_threshold, types, round(types / n, 6) AS type_share, CAST(mass AS DOUBLE) AS mass, round(mass / m, 6) AS mass_share FROM g""",
    "lexical_mass_summary": f"""{_LEX}, t AS (SELECT sum(expected_count) AS total FROM lexicon) SELECT count(*) AS types, sum(expected_count) AS mass, count(*) FILTER (WHERE expected_count <= 1) AS low_count_types,
  min(rank) FILTER (WHERE cumulative >= 0.5 * total) AS support_50, min(rank) FILTER (WHERE cumulative >= 0.9 * total) AS support_90, round(count(*) FILTER (WHERE expected_count <= 1) / count(*), 6) AS low_count_share FROM ranked, t""",
    "usage_rank_summary": """WITH m AS (SELECT form_key, sum(expected_mass) AS mass FROM surface_usage WHERE form_key IS NOT NULL AND expected_mass > 0 AND NOT isnan(expected_mass) GROUP BY 1)
SELECT form_key, mass, round(mass / sum(mass) OVER (), 6) AS share, row_number() OVER (ORDER BY mass DESC, form_key) AS rank FROM m QUALIFY rank <= 10""",
    "pass_dynamics": """WITH d AS (SELECT CASE WHEN length(surface) > 8 THEN 'long' ELSE 'short' END AS metric, CAST(CAST(exported_at AS DATE) AS VARCHAR) AS day, sum(expected_mass) AS value FROM surface_usage
  WHERE expected_mass IS NOT NULL AND NOT isnan(expected_mass) AND exported_at IS NOT NULL GROUP BY ALL), l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY day) AS before FROM d)
SELECT metric, day, round(value, 6) AS value, round(value - before, 6) AS delta, round((value - before) / before, 6) AS relative_delta FROM l""",
    "runtime_rollup": f"""WITH {SEGMENTS}, w AS (SELECT CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'devanagari' ELSE 'iast' END AS script, CAST(sum(length(text)) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS s, CAST(count(DISTINCT split_part(segment_id, ':', 1)) AS DOUBLE) AS d FROM segments WHERE text IS NOT NULL GROUP BY 1)
SELECT script, unnest(['characters', 'segments', 'documents', 'characters_per_segment', 'segments_per_document']) AS metric, round(unnest([c, s, d, c / s, s / d]), 6) AS value FROM w""",
    "boundary_entropy": f"""{_LEX}, e AS (SELECT substr(form_key, i, 1) AS letter, i = length(form_key) AS last, expected_count AS n FROM lexicon, unnest(generate_series(1, length(form_key))) AS u(i)),
r AS (SELECT letter, CAST(sum(n) AS BIGINT) AS uses, coalesce(sum(n) FILTER (WHERE last), 0) / sum(n) AS p FROM e GROUP BY 1)
SELECT letter, uses, round(p, 6) AS p, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) END, 6) AS entropy FROM r""",
    "pair_jaccard_topk": f"""{_PAIR}, k(k) AS (VALUES (10), (100), (1000)), j AS (SELECT a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (form_key))
SELECT CAST(k AS BIGINT) AS k, round(count(*) FILTER (WHERE ra <= k AND rb <= k) / count(*) FILTER (WHERE ra <= k OR rb <= k), 6) AS value FROM j, k GROUP BY k""",
    "pair_l1_spearman": f"""{_PAIR}, j AS (SELECT x.share AS p, y.share AS q, x.rank AS ra, y.rank AS rb FROM (SELECT * FROM a WHERE rank <= 1000) x FULL JOIN (SELECT * FROM b WHERE rank <= 1000) y USING (form_key))
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) + abs(greatest(0, 1 - sum(p)) - greatest(0, 1 - sum(q))), 6) AS l1_with_tail, round(corr(ra, rb), 6) AS spearman, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS shared FROM j""",
    "total_variation": f"{_PAIR} SELECT round(0.5 * sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))), 6) AS value FROM a FULL JOIN b USING (form_key)",
    "jensen_shannon": f"""{_PAIR}, j AS (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM a FULL JOIN b USING (form_key))
SELECT round(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)), 6) AS value FROM j""",
    "scalar_compare": f"""WITH c AS (SELECT source, CAST(count(*) FILTER (WHERE layer = '{CELL_A}') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE layer = '{CELL_B}') AS DOUBLE) AS b FROM documents WHERE layer IN ('{CELL_A}', '{CELL_B}') AND source IS NOT NULL GROUP BY 1)
SELECT source, a, b, b - a AS signed_difference, abs(b - a) AS absolute_difference, round((b - a) / nullif(abs(a), 0), 6) AS relative_difference, round(b / nullif(a, 0), 6) AS ratio, a = 0 AS zero_base FROM c""",
    "minhash_bottomk": f"""WITH {WORDS}, d AS (SELECT cell, substr(sha256(form_key), 1, 16) AS h FROM cells WHERE cell IN ('{CELL_A}', '{CELL_B}')), s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY h) AS r FROM (SELECT DISTINCT cell, h FROM d)),
u AS (SELECT h, count(*) AS n FROM s WHERE r <= 2048 GROUP BY h ORDER BY h LIMIT 2048) SELECT round(count(*) FILTER (WHERE n = 2) / count(*), 6) AS value FROM u""",
    "hash_reservoir": "SELECT document_id, substr(sha256(document_id), 1, 16) AS digest FROM (SELECT DISTINCT document_id FROM canonical_manifest WHERE document_id IS NOT NULL) ORDER BY digest, document_id DESC LIMIT 12",
    "top_reservoir": f"""{_LEX} SELECT category, form_key, expected_count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY expected_count DESC, form_key DESC) AS rank FROM
  (SELECT CASE WHEN length(form_key) > 8 THEN 'long' ELSE 'short' END AS category, form_key, expected_count FROM lexicon)) WHERE rank <= 12""",
}
