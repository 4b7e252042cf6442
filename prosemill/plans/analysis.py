"""Document analysis over the corpus in paragraphs: queries of the one-pass scorer, and the same measures as a plain statement of windows for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks, scoring
from .dialect import SENTENCE, TOKEN
from .shared import kept, rounded, table

#: Measures that the statement below has too; the others need a generator or fits.
IN_SQL = [m for m in scoring.MEASURES if m not in ("logp_per_token_original", "cohesion_delta")]
COUNTS_IN_SQL = [c for c in scoring.COUNTS if c != "cohesion_n_shuffles"]
DOC_TYPES = ("poem", "shortstory", "novel", "prose")


def corpus_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a corpus with a type by id, each line a paragraph."""
    kind = F.element_at(F.array(*[F.lit(x) for x in DOC_TYPES]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("author"), kind.alias("doc_type"), "lang", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def analysis(spark: SparkSession, sf_dir: str, **what) -> DataFrame:
    """All counts and measures of the corpus, by document. what: see `scoring.analyse`."""
    return scoring.analyse(corpus_para(spark, sf_dir), kept, **what)


def doc_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, cohesion=False).select("doc_id", *COUNTS_IN_SQL, *[rounded(m) for m in IN_SQL])


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of the log-probability per token when units are dealt anew, by document."""
    out = analysis(spark, sf_dir, wanted=("s",)).where("cohesion_delta IS NOT NULL")
    return out.select("doc_id", "cohesion_n_shuffles", *[F.round(m, 6).alias(m) for m in ("logp_per_token_original", "cohesion_delta")])


def author_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and the mean of each measure by author; documents without a measure don't count in its mean."""
    rows = analysis(spark, sf_dir, cohesion=False).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author")), "doc_id")
    means = [F.round(F.avg(m), 6).alias(f"{m}_mean") for m in IN_SQL]
    return rows.groupBy("author").agg(F.count("*").alias("docs_count"), F.sum("tokens_count").alias("tokens_total"), *means)


def _segments(name: str, pattern: str | None) -> str:
    """Spans of sentences (matches of a pattern, by what stands before each) or of what a separator parts, and their tokens by place."""
    if pattern:
        pieces = f"SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', '\\1' || chr(1), 'g'), chr(1)) AS l FROM c)"
        span = f"doc_id, i, e - length(regexp_extract(piece, '(?:{pattern})$')) AS a, e AS b, regexp_extract(piece, '(?:{pattern})$') AS held"
    else:
        gap = "\\n" if name == "line" else "\\n\\s*\\n"
        pieces = f"SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '({gap})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS l FROM c)"
        end = "least(e + 1, total)" if name == "line" else "e"
        span = f"doc_id, i, e - length(piece) AS a, {end} AS b, CASE WHEN i % 2 = 0 THEN piece ELSE '' END AS held"
    return f"""{name}_spans AS (SELECT * FROM (SELECT {span} FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(length(piece)) OVER (PARTITION BY doc_id) AS total FROM ({pieces}))) WHERE regexp_matches(held, '[^\\s]')),
 {name}_means AS (SELECT s.doc_id, p.i, avg(s.s) AS m,
   count(*)::DOUBLE AS n FROM scored s JOIN {name}_spans p ON p.doc_id = s.doc_id AND s.a >= p.a AND s.a < p.b GROUP BY s.doc_id, p.i),
 {name}_facts AS (SELECT doc_id, count(*) AS {name}_count, avg(n) AS {name}_tokens_mean, quantile_cont(n, 0.9) AS {name}_tokens_p90,
   CASE WHEN count(*) > 1 THEN stddev_pop(m) / (abs(avg(m)) + 1e-12) END AS {name}_burst_cv,
  CASE WHEN count(*) > 1 THEN stddev_pop(n) / (abs(avg(n)) + 1e-12) END AS {name}_len_cv FROM {name}_means GROUP BY doc_id)"""


def _gaps(name: str, mask: str) -> str:
    """Distances between marked places of a document."""
    return f"{name} AS (SELECT doc_id, avg(g) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(g) / (avg(g) + 1e-12) END AS cv, quantile_cont(g, 0.5) AS med FROM (SELECT doc_id, (i - lag(i) OVER (PARTITION BY doc_id ORDER BY i))::DOUBLE AS g FROM near WHERE {mask}) WHERE g IS NOT NULL GROUP BY doc_id)"


#: The corpus in paragraphs, as SQL.
CORPUS_SQL = "SELECT doc_id, source AS author, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


def statement(corpus: str = CORPUS_SQL) -> str:
    """doc_id, counts and measures; one row per token, joined to its pair's share and its context's distribution. corpus: SQL of doc_id, author, text."""
    return rf"""c AS ({corpus}),
 t AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS v FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS l FROM c)),
 w AS (SELECT doc_id, idx, v, lag(v) OVER d AS before, sum(length(v)) OVER d - length(v) AS a FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY idx)),
 u AS (SELECT v, count(*) AS c FROM t GROUP BY v), z AS (SELECT sum(c) AS n, count(*) AS k FROM u),
 g AS (SELECT before, v, count(*) AS c FROM w WHERE before IS NOT NULL GROUP BY before, v),
 level AS (SELECT before, c, sum(count(*)) OVER (PARTITION BY before ORDER BY c DESC) AS r FROM g GROUP BY before, c),
 list AS (SELECT before, c, row_number() OVER k AS place, sum(c) OVER k - c AS above FROM g WINDOW k AS (PARTITION BY before ORDER BY c DESC,
   v ROWS UNBOUNDED PRECEDING)),
 context AS (SELECT before, sum(c) AS total, greatest(0.0, ln(sum(c)) - sum(c * ln(c)) / sum(c)) AS h, sum(c) FILTER (WHERE place <= 10) / sum(c) AS top10 FROM list GROUP BY before),
 wide AS (SELECT l.before, count(*) AS width FROM list l JOIN context x ON x.before = l.before WHERE l.above < 0.9 * x.total GROUP BY l.before),
 scored AS (SELECT w.doc_id, w.idx - 1 AS i, w.a, w.v, round(0 - ln(0.7 * g.c / x.total + 0.3 * (u.c + 1) / (z.n + z.k + 1)), 9) AS s, x.h, x.top10, d.width,
   l.r / z.k AS r,
  CASE WHEN NOT regexp_matches(w.v, '[\p{{L}}\p{{N}}]') THEN 1.0 ELSE 0.0 END AS punct, CASE WHEN len(regexp_extract_all(w.v,
   '\p{{L}}')) >= 3 THEN 1.0 ELSE 0.0 END AS content
  FROM w JOIN g ON g.before = w.before AND g.v = w.v JOIN level l ON l.before = g.before AND l.c = g.c JOIN context x ON x.before = w.before JOIN wide d ON d.before = w.before JOIN u ON u.v = w.v CROSS JOIN z),
 stats AS (SELECT doc_id, count(*) AS n, avg(s) AS mean, stddev_pop(s) AS sd, quantile_cont(s, 0.5) AS med, quantile_cont(s, 0.1) AS s10, quantile_cont(s, 0.25) AS s25,
   quantile_cont(s, 0.75) AS s75, quantile_cont(s, 0.9) AS s90, quantile_cont(h, 0.1) AS h10, quantile_cont(h, 0.5) AS h50, quantile_cont(h, 0.9) AS h90,
  avg(h) AS h, quantile_cont(r, 0.1) AS r10, avg(r) AS r, stddev_pop(r) AS r_sd, quantile_cont(s / greatest(h, 1), 0.5) AS norm_med FROM scored GROUP BY doc_id),
 near AS (SELECT s.*, n, mean, sd, med, s.s - mean AS z, s.s >= mean + sd AS high, s.s <= med AS low, lag(s.s) OVER d AS s1, lag(s.s, 2) OVER d AS s2,
   lead(s.s) OVER d AS after, lag(s.s <= med) OVER d AS low1, lag(punct) OVER d AS punct1, lag(content) OVER d AS content1,
  lead(punct) OVER d AS punct2, lead(content) OVER d AS content2,
   avg(s.h) OVER (PARTITION BY s.doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS cool FROM scored s JOIN stats USING (doc_id) WINDOW d AS (PARTITION BY s.doc_id ORDER BY i)),
 {_gaps("peak_gaps", "high AND s > s1 AND s >= after")}, {_gaps("high_gaps", "high")},
 orders AS (SELECT doc_id, 0 - sum(k / n * ln(k / n)) / ln(6) AS pe FROM (SELECT doc_id, p, count(*)::DOUBLE AS k,
   sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id,
   (s2 <= s1)::INT * 4 + (s1 <= s)::INT * 2 + (s2 <= s)::INT AS p FROM near WHERE s2 IS NOT NULL) GROUP BY doc_id, p) GROUP BY doc_id),
 blocks AS (SELECT x.doc_id, z.size, x.i // z.size AS block, x.i, x.s FROM near x JOIN (SELECT unnest([8, 16, 32, 64, 128, 256,
   512]) AS size) z ON x.n >= 64 AND 2 * z.size <= x.n WHERE x.i < x.n // z.size * z.size),
 walks AS (SELECT doc_id, size, block, sd, sum(c) OVER (PARTITION BY doc_id, size, block ORDER BY i) AS y FROM (SELECT *, s - avg(s) OVER b AS c,
   stddev_pop(s) OVER b AS sd FROM blocks WINDOW b AS (PARTITION BY doc_id, size, block))),
 hurst AS (SELECT doc_id, regr_slope(ln(rs), ln(size)) AS hurst_rs FROM (SELECT doc_id, size, avg(rs) AS rs FROM (SELECT doc_id, size, block,
   CASE WHEN max(y) - min(y) < 1e-9 THEN 0 ELSE (max(y) - min(y)) / (max(sd) + 1e-12) END AS rs FROM walks GROUP BY doc_id, size, block) GROUP BY doc_id,
   size) WHERE rs > 0 GROUP BY doc_id HAVING count(*) >= 2),
 {_segments("sent", SENTENCE)}, {_segments("para", None)}, {_segments("line", None)},
 moved AS (SELECT doc_id, max(n) AS n, avg(exp(0 - s)) AS p_true_mean, max(mean) AS surprisal_mean, max(med) AS surprisal_median, sum(z ** 3) / max(n) AS z3,
   sum(z ** 4) / max(n) AS z4, max(sd) AS sd, avg(abs(s - s1)) AS masd, sum(z * (s1 - mean)) / (sum(z * z) + 1e-12) AS acf1,
   sum(z * (s2 - mean)) / (sum(z * z) + 1e-12) AS acf2,
  avg(exp(h)) AS eff_support_mean, avg(width) AS nucleus_w_mean, avg(top10) AS top10_mass_mean, avg(s / greatest(h, 1)) AS norm_surprisal_mean_clipped,
   100.0 * count(*) FILTER (WHERE high AND s > s1 AND s >= after) / max(n) AS peaks,
  count(*) FILTER (WHERE low) / count(*) FILTER (WHERE low AND low1 IS DISTINCT FROM TRUE) AS run_low,
   count(*) FILTER (WHERE NOT low) / nullif(count(*) FILTER (WHERE NOT low AND low1 IS DISTINCT FROM FALSE), 0) AS run_high, avg(content) AS content_fraction,
   avg(punct) AS punct_rate, avg(CASE WHEN contains(v, chr(10)) THEN 1.0 ELSE 0.0 END) AS newline_rate,
  coalesce(avg(content1) FILTER (WHERE high), 0.0) AS prev_content, coalesce(avg(punct1) FILTER (WHERE high), 0.0) AS prev_punct,
   coalesce(avg(content2) FILTER (WHERE high), 0.0) AS next_content, coalesce(avg(punct2) FILTER (WHERE high), 0.0) AS next_punct,
   avg(h - cool) FILTER (WHERE high AND i + 3 < n) AS cooldown FROM near GROUP BY doc_id),
 measured AS (SELECT c.doc_id, c.author, coalesce(m.n, 0) AS tokens_count, coalesce(sent_count, 0) AS sent_count, coalesce(para_count, 0) AS para_count,
   coalesce(line_count, 0) AS line_count, p_true_mean, surprisal_mean, surprisal_median, s.s10 AS surprisal_p10, s.s90 AS surprisal_p90,
  CASE WHEN m.n >= 4 AND m.sd > 1e-12 THEN s75 - s25 END AS surprisal_iqr, CASE WHEN m.n >= 5 THEN m.sd / s.mean END AS surprisal_cv,
   CASE WHEN m.n >= 5 THEN masd END AS surprisal_masd, CASE WHEN m.n >= 4 AND m.sd > 1e-12 THEN z3 / m.sd ** 3 END AS surprisal_skewness,
   CASE WHEN m.n >= 4 AND m.sd > 1e-12 THEN z4 / m.sd ** 4 - 3 END AS surprisal_kurtosis,
  CASE WHEN m.n >= 5 THEN acf1 END AS surprisal_acf1, CASE WHEN m.n >= 5 THEN acf2 END AS surprisal_acf2, s.h AS entropy_mean, h50 AS entropy_median, h10 AS entropy_p10,
   h90 AS entropy_p90, CASE WHEN m.n >= 4 AND s.h > 1e-12 THEN (h90 - h10) / s.h END AS entropy_range_ratio, s.h / ln(2) AS entropy_bits_mean, s.mean / ln(2) AS bpt_mean,
   eff_support_mean,
  r AS rank_percentile_mean, CASE WHEN m.n >= 2 THEN r_sd / r END AS rank_percentile_cv, CASE WHEN m.n >= 2 THEN r10 END AS rank_percentile_p10, nucleus_w_mean,
   top10_mass_mean, 1 - top10_mass_mean AS tail_mass_mean, norm_surprisal_mean_clipped, norm_med AS norm_surprisal_median, s.mean / greatest(s.h,
   1e-12) AS norm_surprisal_ratio_of_means,
  CASE WHEN m.n >= 5 THEN peaks END AS high_surprise_rate_per_100, CASE WHEN m.n >= 5 THEN pg.mean END AS high_surprise_ipi_mean,
   CASE WHEN m.n >= 5 THEN pg.cv END AS high_surprise_ipi_cv, CASE WHEN m.n >= 5 THEN run_low END AS run_low_mean_len,
   CASE WHEN m.n >= 5 THEN run_high END AS run_high_mean_len, pe AS perm_entropy, hurst_rs,
  content_fraction, punct_rate, newline_rate, prev_content AS spike_prev_content_rate, prev_punct AS spike_prev_punct_rate, next_content AS spike_next_content_rate,
   next_punct AS spike_next_punct_rate, hg.mean AS ipi_mean, hg.cv AS ipi_cv, hg.med AS ipi_p50, cooldown AS cooldown_entropy_drop_3,
  {", ".join(scoring.LEVELS)} FROM c LEFT JOIN moved m USING (doc_id) LEFT JOIN stats s USING (doc_id) LEFT JOIN peak_gaps pg USING (doc_id) LEFT JOIN high_gaps hg USING (doc_id) LEFT JOIN orders USING (doc_id) LEFT JOIN hurst USING (doc_id) LEFT JOIN sent_facts USING (doc_id) LEFT JOIN para_facts USING (doc_id) LEFT JOIN line_facts USING (doc_id))"""


def divergence(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """group, pairs, kl and squashed (tanh of a tenth): the Kullback-Leibler divergence of a group's next-token distributions from those of all groups, averaged over its pairs of tokens.

    Pairs and contexts are counted by group within stretches of text, then summed; the logarithm of the two shares' quotient falls apart into terms of a pair and terms of its context, so nothing is joined."""
    rows = kept(chunks.group_pairs(df, group, text), "pairs")

    def terms(of: DataFrame, *keys: str) -> DataFrame:
        """Sums over a group's keys of c times the logarithm of its share of all groups' c."""
        own = of.repartition(*keys).groupBy(*keys, group).agg(F.sum("c").alias("c"))  # all groups of a key in one partition
        own = own.withColumn("every", F.sum("c").over(Window.partitionBy(*keys)))
        return own.groupBy(group).agg(F.sum("c").alias("pairs"), F.sum(F.col("c") * (F.log("c") - F.log("every"))).alias("term"))

    of_pairs, of_contexts = terms(rows.where("v IS NOT NULL"), "b", "v").withColumn("sign", F.lit(1)), terms(rows.where("v IS NULL"), "b").withColumn("sign", F.lit(-1))
    pairs = F.sum(F.when(F.col("sign") > 0, F.col("pairs")))
    out = of_pairs.unionByName(of_contexts).groupBy(group).agg(pairs.alias("pairs"), (F.sum(F.col("sign") * F.col("term")) / pairs).alias("kl"))
    return out.withColumn("squashed", F.tanh(0.1 * F.col("kl")))


def author_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(corpus_para(spark, sf_dir), "author").select("author", "pairs", F.round("kl", 6).alias("kl"), F.round("squashed", 6).alias("squashed"))


def doc_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadence of the documents of five scored tokens or more by source, from shares of all tokens; the statement of this name is its SQL."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_type", F.lit(None).cast("string"))
    rows = scoring.analyse(docs, kept, contexts=False).where("tokens_count >= 5").join(docs.select("doc_id", "source"), "doc_id")
    mean = lambda m, name: F.round(F.avg(m), 6).alias(name)
    means = [mean(m, m) for m in ("surprisal_mean", "surprisal_median", "surprisal_p90", "surprisal_cv", "high_surprise_rate_per_100")]
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens_count").alias("tokens_total"), *means, mean("high_surprise_ipi_mean", "ipi_mean"))


QUERIES = {"doc_cadence": doc_cadence, "author_divergence": author_divergence, "doc_analysis": doc_analysis, "author_means": author_means, "cohesion": cohesion}
ORACLES = {
    "author_divergence": rf"""WITH t AS (SELECT author, doc_id, unnest(range(len(l))) AS i, unnest(l) AS v FROM (SELECT source AS author, doc_id, regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '{TOKEN}') AS l FROM documents)),
 p AS (SELECT author, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS b, v FROM t), g AS (SELECT author, b, v, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY author, b, v),
 s AS (SELECT author, c, c / sum(c) OVER (PARTITION BY author, b) AS own, sum(c) OVER (PARTITION BY b, v) / sum(c) OVER (PARTITION BY b) AS every FROM g), k AS (SELECT author, sum(c)::BIGINT AS pairs, sum(c * ln(own / every)) / sum(c) AS kl FROM s GROUP BY author)
 SELECT author, pairs, round(kl, 6) AS kl, round(tanh(0.1 * kl), 6) AS squashed FROM k""",
    "doc_analysis": f"WITH {statement()} SELECT doc_id, {', '.join(COUNTS_IN_SQL)}, {', '.join(f'round({m}, 6) AS {m}' for m in IN_SQL)} FROM measured",
    "author_means": f"WITH {statement()} SELECT author, count(*) AS docs_count, sum(tokens_count)::BIGINT AS tokens_total, {', '.join(f'round(avg({m}), 6) AS {m}_mean' for m in IN_SQL)} FROM measured GROUP BY author",
}
