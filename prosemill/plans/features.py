"""Surface measures, phrase rates and the feature vector of each document, with SQL for DuckDB that counts exploded rows instead of folding arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import surface as S
from .analysis import analysis, corpus_para, statement
from .shared import kept

#: The features of the quality model, in its order.
SCHEMA = """high_surprise_rate_per_100 ipi_mean ipi_cv surprisal_cv surprisal_acf1 run_low_mean_len run_high_mean_len surprisal_skewness surprisal_iqr
    entropy_mean nucleus_w_mean entropy_range_ratio word_hapax_ratio adjacent_word_repeat_rate bigram_repeat_rate trigram_repeat_rate
    sent_burst_cv para_burst_cv sent_len_cv para_len_cv hurst_rs word_len_mean alpha_char_fraction punct_variety_per_1000_chars content_fraction
    semicolon_per_100w colon_per_100w exclamation_rate one_sent_para_rate function_word_rate parenthetical_rate slop_phrase_density paragraph_metric_cv""".split()
_R = lambda names: [F.round(n, 6).alias(n) for n in names]


def surface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.surface(corpus_para(spark, sf_dir)).select("doc_id", *_R(S.METRICS))


def taxonomy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.taxonomy(corpus_para(spark, sf_dir)).select("doc_id", *_R(S.TAXONOMY))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the features by name; what a document doesn't have, or isn't finite, is 0."""
    text = S.taxonomy(S.surface(corpus_para(spark, sf_dir))).select("doc_id", *[c for c in SCHEMA if c in S.METRICS or c in S.TAXONOMY])
    rows = analysis(spark, sf_dir, cohesion=False, wanted=("s", "h", "width")).select("doc_id", *[c for c in SCHEMA if c not in text.columns]).join(text, "doc_id")
    return rows.select("doc_id", *[F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0)).alias(c) for c in SCHEMA])


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 33 features in order, joined by blanks with six decimals."""
    rows = kept(features(spark, sf_dir), "features")
    return rows.select("doc_id", *_R(SCHEMA))


_Q = lambda p: p.replace("'", "''")
_LISTED = lambda words: "[" + ", ".join("'" + _Q(w) + "'" for w in words) + "]"
_HITS = lambda phrases: " + ".join(f"(length(low) - length(replace(low, '{_Q(p)}', ''))) / {len(p)}" for p in phrases)
_LINE = lambda p, name: f"avg(CASE WHEN regexp_matches(x, '{_Q(p)}') THEN 1.0 ELSE 0.0 END) AS line_{name}_fraction"
_SURFACE = rf"""c AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), w0 AS (SELECT doc_id, unnest(range(len(l))) AS i, lower(unnest(l)) AS w FROM (SELECT doc_id, regexp_extract_all(t, '{_Q(S.WORD)}') AS l FROM c)),
 w1 AS (SELECT *, length(w)::DOUBLE AS n, greatest(1, len(regexp_extract_all(replace(w, '''', ''), '[aeiouy]+')) - CASE WHEN regexp_matches(replace(w, '''', ''),
   '[^ly]e$') AND len(regexp_extract_all(replace(w, '''', ''), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)::DOUBLE AS y, lead(w) OVER d AS w2, lead(w,
   2) OVER d AS w3 FROM w0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT doc_id, w, count(*) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC) AS r FROM w0 GROUP BY doc_id, w),
 ff AS (SELECT doc_id, count(*) AS u, count(*) FILTER (WHERE c = 1) AS h, sum(c) FILTER (WHERE r <= 5) AS five FROM f GROUP BY doc_id),
 ww AS (SELECT doc_id, count(*) AS k, avg(n) AS n, quantile_cont(n, 0.9) AS n90, stddev_pop(n) AS nsd, avg(y) AS y, quantile_cont(y, 0.9) AS y90, stddev_pop(y) AS ysd,
   avg((w = w2)::INT) AS adj, count(DISTINCT w || ' ' || w2) AS g2, count(DISTINCT w || ' ' || w2 || ' ' || w3) AS g3 FROM w1 GROUP BY doc_id),
 ss AS (SELECT doc_id, avg(n) AS m, quantile_cont(n, 0.9) AS p90, stddev_pop(n) AS sd, count(*) AS k FROM (SELECT doc_id, len(regexp_extract_all(x,
   '{_Q(S.WORD)}'))::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{S.SENTENCE}')) AS x FROM c) WHERE regexp_matches(x, '\S')) GROUP BY doc_id),
 ll AS (SELECT doc_id, avg(CASE WHEN regexp_matches(x, '{_Q(S.CODE)}') OR sy / greatest(1, sy + al) >= 0.33 THEN 1.0 ELSE 0.0 END) AS line_code_fraction,
   {", ".join(_LINE(p, n) for n, p in S.LINES.items())} FROM (SELECT *, len(regexp_extract_all(x, '{_Q(S.SYMBOLS)}')) AS sy, len(regexp_extract_all(x,
   '\p{{L}}')) AS al FROM (SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '\s+$', '') AS x FROM c) WHERE regexp_matches(x, '\S')) GROUP BY doc_id),
 surface AS (SELECT c.doc_id, length(t)::DOUBLE AS chars_count, len(regexp_extract_all(t, '\p{{L}}')) / nullif(length(t), 0) AS alpha_char_fraction,
   len(regexp_extract_all(t, '\p{{Nd}}')) / nullif(length(t), 0) AS digit_char_fraction, len(regexp_extract_all(t, '{_Q(S.SYMBOLS)}')) / nullif(length(t),
   0) AS symbol_char_fraction,
  len(regexp_extract_all(t, '\s')) / nullif(length(t), 0) AS whitespace_char_fraction, CASE WHEN t <> '' THEN len(list_distinct(regexp_extract_all(t,
   '{_Q(S.MARKS)}')))::DOUBLE END AS punct_charset_size, CASE WHEN length(t) >= 200 THEN len(list_distinct(regexp_extract_all(t,
   '{_Q(S.MARKS)}'))) / (length(t) / 1000.0) END AS punct_variety_per_1000_chars,
  coalesce(ww.k, 0)::DOUBLE AS word_count, coalesce(u, 0)::DOUBLE AS word_unique, u / ww.k AS word_ttr, h / ww.k AS word_hapax_ratio, five / ww.k AS word_top5_frac,
   CASE WHEN ww.k >= 2 THEN adj END AS adjacent_word_repeat_rate, CASE WHEN ww.k >= 3 THEN 1 - g2 / (ww.k - 1) END AS bigram_repeat_rate,
   CASE WHEN ww.k >= 3 THEN 1 - g3 / (ww.k - 2) END AS trigram_repeat_rate,
  ww.n AS word_len_mean, n90 AS word_len_p90, CASE WHEN ww.k >= 2 THEN nsd / ww.n END AS word_len_cv, y AS syllables_per_word_mean, y90 AS syllables_per_word_p90,
   CASE WHEN ww.k >= 2 THEN ysd / y END AS syllables_per_word_cv, ss.m AS sent_words_mean, ss.p90 AS sent_words_p90,
   CASE WHEN ss.k >= 2 AND ss.m > 0 THEN ss.sd / ss.m END AS sent_words_cv,
  line_code_fraction, line_list_fraction, line_heading_fraction, line_quote_fraction, line_indented_fraction FROM c LEFT JOIN ww USING (doc_id) LEFT JOIN ff USING (doc_id) LEFT JOIN ss USING (doc_id) LEFT JOIN ll USING (doc_id))"""
_AFTER = "string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_TAXONOMY = rf"""c2 AS (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS x, lower(text) AS low FROM documents), k2 AS (SELECT *, regexp_extract_all(x, '{_Q(S.WORD)}') AS w FROM c2),
 s2 AS (SELECT * FROM (SELECT doc_id, unnest({_AFTER}) AS s FROM c2) WHERE regexp_matches(s, '\S')),
 p2 AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS x FROM (SELECT doc_id, string_split(regexp_replace(x, '\n\s*\n+', chr(2), 'g'),
   chr(2)) AS l FROM c2)) WHERE regexp_matches(x, '\S')),
 ps AS (SELECT doc_id, p, count(*) AS k, sum(len(regexp_extract_all(s, '{_Q(S.WORD)}'))) / count(*) AS a FROM (SELECT doc_id, p,
   unnest({_AFTER}) AS s FROM p2) WHERE regexp_matches(s, '\S') GROUP BY doc_id, p),
 pf AS (SELECT doc_id, avg((k <= 1)::INT) AS one, CASE WHEN count(*) > 1 THEN stddev_pop(a) / greatest(avg(a), 1e-12) ELSE 0 END AS cv FROM ps GROUP BY doc_id),
 of AS (SELECT doc_id, CASE WHEN sum(c) > 1 THEN ln(sum(c)) - sum(c * ln(c)) / sum(c) ELSE 0 END AS e FROM (SELECT doc_id, o, count(*)::DOUBLE AS c FROM (SELECT doc_id,
   array_to_string(list_transform(regexp_extract_all(s, '{_Q(S.WORD)}')[1:3], lambda z: lower(z)), ' ') AS o FROM s2) WHERE o <> '' GROUP BY doc_id, o) GROUP BY doc_id),
 sf AS (SELECT doc_id, avg(regexp_matches(s, '[?]\s*$')::INT) AS q, avg(regexp_matches(s, '!\s*$')::INT) AS b FROM s2 GROUP BY doc_id),
 m2 AS (SELECT *, greatest(1, len(w))::DOUBLE AS k, list_transform(w, lambda z: lower(z)) AS lw FROM k2),
 taxonomy AS (SELECT m.doc_id, 100 * len(regexp_extract_all(x, ',')) / k AS comma_per_100w, 100 * len(regexp_extract_all(x, ';')) / k AS semicolon_per_100w,
   100 * len(regexp_extract_all(x, '—|–| - ')) / k AS dash_per_100w, 100 * len(regexp_extract_all(x, ':')) / k AS colon_per_100w, coalesce(q, 0) AS question_rate,
   coalesce(b, 0) AS exclamation_rate, coalesce(one, 0) AS one_sent_para_rate,
  len(list_filter(lw, lambda z: list_contains({_LISTED(S.FUNCTION_WORDS)}, z))) / k AS function_word_rate, len(list_filter(lw,
   lambda z: list_contains({_LISTED(S.MARKERS)}, z))) / k AS discourse_marker_rate, 100 * least(len(regexp_extract_all(x, '[(]')), len(regexp_extract_all(x,
   '[)]'))) / k AS parenthetical_rate,
  100 * ({_HITS(S.WORN)}) / k AS slop_phrase_density, 100 * ({_HITS(S.HEDGING)}) / k AS hedging_phrase_rate, coalesce(e, 0) AS sentence_opener_entropy, coalesce(cv, 0) AS paragraph_metric_cv FROM m2 m LEFT JOIN sf USING (doc_id) LEFT JOIN pf USING (doc_id) LEFT JOIN of USING (doc_id))"""
_ROUNDED = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
QUERIES = {f.__name__: f for f in (surface_metrics, taxonomy_features, feature_vector)}
ORACLES = {
    "surface_metrics": f"WITH {_SURFACE} SELECT doc_id, {_ROUNDED(S.METRICS)} FROM surface",
    "taxonomy_features": f"WITH {_TAXONOMY} SELECT doc_id, {_ROUNDED(S.TAXONOMY)} FROM taxonomy",
    "feature_vector": f"SELECT a.doc_id, {', '.join(f'round(coalesce({n}, 0.0), 6) AS {n}' for n in SCHEMA)} FROM (WITH {statement()} SELECT * FROM measured) a JOIN (WITH {_SURFACE} SELECT * FROM surface) b ON a.doc_id = b.doc_id JOIN (WITH {_TAXONOMY} SELECT * FROM taxonomy) t ON t.doc_id = a.doc_id",
}
