"""Queries over text, token series, corpora and evaluations, by name."""

from __future__ import annotations

from .dialect import Statement as S
from .prose import PROSE

R6 = lambda x, name: f"round({x}, 6) AS {name}"

TEXT = {
    "word_counts_per_doc": S(
        "SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_words, count(*) AS n_distinct, round(count(*) / sum(c), 6) AS ttr, round(count(CASE WHEN c = 1 THEN 1 END) / sum(c), 6) AS hapax_ratio, round(sum(CASE WHEN k <= 5 THEN c ELSE 0 END) / sum(c), 6) AS top5_frac FROM counted GROUP BY doc_id",
        "words", "counted AS (SELECT doc_id, v, count(*) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, v) AS k FROM words GROUP BY doc_id, v)",
    ),
    "repeat_rates": S(
        "SELECT doc_id, count(*) AS n, round(avg(CASE WHEN v = w1 THEN 1.0 WHEN w1 IS NOT NULL THEN 0.0 END), 6) AS adjacent_repeat, round(1 - count(DISTINCT CASE WHEN w1 IS NOT NULL THEN concat(v, ' ', w1) END) / nullif(count(w1), 0), 6) AS bigram_repeat, round(1 - count(DISTINCT CASE WHEN w2 IS NOT NULL THEN concat(v, ' ', w1, ' ', w2) END) / nullif(count(w2), 0), 6) AS trigram_repeat FROM grams GROUP BY doc_id HAVING count(*) >= 4",
        "words", "grams AS (SELECT doc_id, v, lead(v, 1) OVER w AS w1, lead(v, 2) OVER w AS w2 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY idx))",
    ),
    "char_class_fractions": S(
        "SELECT doc_id, length(text) AS n, round(MATCHES(text, R'\\p{L}') / nullif(length(text), 0), 6) AS letters, round(MATCHES(text, R'\\p{N}') / nullif(length(text), 0), 6) AS digits, round(MATCHES(text, R'[ \\t\\n]') / nullif(length(text), 0), 6) AS blanks, round(MATCHES(text, R'\\p{Lu}') / nullif(length(text), 0), 6) AS capitals FROM (SELECT doc_id, text FROM documents) d",
    ),
    "word_len_syllable_stats": S(
        "SELECT doc_id, round(avg(l), 6) AS len_mean, round(PCT(l, 0.9), 6) AS len_p90, round(stddev_pop(l) / nullif(avg(l), 0), 6) AS len_cv, round(avg(y), 6) AS syllables_mean, round(PCT(y, 0.9), 6) AS syllables_p90 FROM sized GROUP BY doc_id HAVING count(*) >= 2",
        "words", "sized AS (SELECT doc_id, CAST(length(v) AS DOUBLE) AS l, CAST(greatest(1, MATCHES(v, R'[aeiouy]+') - CASE WHEN v LIKE '%e' AND NOT v LIKE '%le' AND MATCHES(v, R'[aeiouy]+') > 1 THEN 1 ELSE 0 END) AS DOUBLE) AS y FROM words)",
    ),
    "sentence_stats": S(
        "SELECT doc_id, count(*) AS n_sentences, round(avg(n), 6) AS words_mean, round(PCT(n, 0.9), 6) AS words_p90, round(stddev_pop(n) / nullif(avg(n), 0), 6) AS words_cv FROM counted GROUP BY doc_id",
        "sentences", "counted AS (SELECT doc_id, idx, CAST(MATCHES(v, R'[A-Za-z]+') AS DOUBLE) AS n FROM sentences WHERE trim(v) <> '')",
    ),
    "line_kind_fractions": S(
        "SELECT doc_id, count(*) AS n_lines, round(avg(CASE WHEN MATCHES(v, R'^[ ]*([-*+]|[0-9]+[.)])[ ]') > 0 THEN 1.0 ELSE 0.0 END), 6) AS list_fraction, round(avg(CASE WHEN v LIKE '#%' THEN 1.0 ELSE 0.0 END), 6) AS heading_fraction, round(avg(CASE WHEN v LIKE '>%' THEN 1.0 ELSE 0.0 END), 6) AS quote_fraction, round(avg(CASE WHEN v LIKE '    %' THEN 1.0 ELSE 0.0 END), 6) AS indented_fraction FROM lines WHERE trim(v) <> '' GROUP BY doc_id",
        "lines",
    ),
    "doc_type_detect": S(
        "SELECT d.doc_id, CASE WHEN l.n > 3 AND l.short / l.n > 0.7 AND l.mean < 50 THEN 'poem' WHEN MATCHES(d.text, R'[^ \\n\\t]+') > 1500 THEN 'shortstory' ELSE 'prose' END AS doc_type FROM documents d LEFT JOIN kinds l ON d.doc_id = l.doc_id",
        "lines", "kinds AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN length(trim(v)) < 60 THEN 1.0 ELSE 0.0 END) AS short, avg(length(trim(v))) AS mean FROM lines WHERE trim(v) <> '' GROUP BY doc_id)",
    ),
    "text_stats": S("SELECT doc_id, sum(length(v)) + max(idx) AS chars, max(idx) AS newlines, count(*) AS n_lines, round(avg(CASE WHEN trim(v) <> '' THEN length(v) END), 6) AS mean_line FROM lines GROUP BY doc_id", "lines"),
    "opener_entropy": S(
        "SELECT doc_id, round(0 - sum(c / n * ln(c / n)), 6) AS opener_entropy FROM (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) AS n FROM openers WHERE w <> '' GROUP BY doc_id, w) x GROUP BY doc_id",
        "sentences", "openers AS (SELECT doc_id, lower(regexp_extract(v, R'[A-Za-z]+', 0)) AS w FROM sentences)",
    ),
    "punctuation_rates": S(
        "SELECT doc_id, round(100.0 * MATCHES(text, R',') / nullif(w, 0), 6) AS commas, round(100.0 * MATCHES(text, R'[;:]') / nullif(w, 0), 6) AS colons, round(100.0 * MATCHES(text, R'!') / nullif(w, 0), 6) AS bangs, round(100.0 * MATCHES(text, R'[?]') / nullif(w, 0), 6) AS questions FROM (SELECT doc_id, text, MATCHES(text, R'[A-Za-z]+') AS w FROM documents) d",
    ),
    "bureaucracy_droning": S(
        "SELECT doc_id, round(len, 6) AS mean_len, round(long, 6) AS long_rate, round(nom, 6) AS nominal_rate, round(5 * nom + 1.5 * long + 0.1 * greatest(0, len - 4.7), 6) AS droning FROM rates",
        "words", "rates AS (SELECT doc_id, avg(length(v)) AS len, avg(CASE WHEN length(v) >= 8 THEN 1.0 ELSE 0.0 END) AS long, avg(CASE WHEN v LIKE '%tion' OR v LIKE '%ment' OR v LIKE '%ness' OR v LIKE '%ity' THEN 1.0 ELSE 0.0 END) AS nom FROM words GROUP BY doc_id)",
    ),
    "slug_ids": S("SELECT p_partkey, trim(BOTH '_' FROM regexp_replace(lower(p_name), R'[^a-z0-9]+', '_'SLUG)) AS slug, substr(sha1(p_name), 1, 12) AS id FROM part"),
    "author_norm": S("SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(c_name, R'[#.]+', ' 'SLUG), R' +', ' 'SLUG))) AS author FROM customer"),
    "json_props": S("SELECT event_type, count(*) AS n, CAST(sum(CAST(JSON(props, k) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type"),
}

TOKENS = {
    "tokens_flat": S(
        "SELECT doc_id, idx, v AS tok, CAST(coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, CAST(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end, CASE WHEN MATCHES(v, R'[\\p{L}\\p{N}]') = 0 THEN 1 ELSE 0 END AS is_punct, CAST(sum(MATCHES(v, R'\\n')) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM tokens",
        "tokens",
    ),
    "unigram_lm": S("SELECT v AS tok, c AS n, round(-ln((c + 1) / (n + k + 1)), 6) AS surprisal, rank() OVER (ORDER BY c DESC) AS rank FROM unigram CROSS JOIN size", "tokens unigram"),
    "bigram_lm": S(
        "SELECT b.a, b.b, b.c AS n, round(-ln(0.7 * b.c / h.n + 0.3 * (u.c + 1) / (z.n + z.k + 1)), 6) AS surprisal FROM bigrams b JOIN (SELECT a, sum(c) AS n FROM bigrams GROUP BY a) h ON b.a = h.a JOIN unigram u ON b.b = u.v CROSS JOIN size z",
        "tokens unigram", "follow AS (SELECT doc_id, v AS a, lead(v) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM tokens), bigrams AS (SELECT a, b, count(*) AS c FROM follow WHERE b IS NOT NULL GROUP BY a, b)",
    ),
    "doc_cadence": S(
        "SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens_total, round(avg(mean), 6) AS surprisal_mean, round(avg(med), 6) AS surprisal_median, round(avg(p90), 6) AS surprisal_p90, round(avg(sd / mean), 6) AS surprisal_cv, round(avg(rate), 6) AS high_surprise_rate_per_100, round(avg(ipi), 6) AS ipi_mean FROM docs GROUP BY source",
        "tokens unigram surprisal doc_stats near", "peaks AS (SELECT doc_id, idx, idx - lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS gap FROM near WHERE s >= mean + sd AND s > prev AND s >= next), found AS (SELECT doc_id, count(*) AS c, avg(gap) AS ipi FROM peaks GROUP BY doc_id), docs AS (SELECT d.*, 100.0 * coalesce(f.c, 0) / d.n AS rate, f.ipi FROM doc_stats d LEFT JOIN found f ON d.doc_id = f.doc_id)",
    ),
    "doc_signature": S(
        "SELECT d.doc_id, d.n, round(d.mean, 6) AS surprisal_mean, round(d.p10, 6) AS surprisal_p10, round(d.p90, 6) AS surprisal_p90, round(d.sd / d.mean, 6) AS surprisal_cv, round(m.masd, 6) AS surprisal_masd, round(m.acf1, 6) AS acf1, round(m.spikes, 6) AS spike_fraction FROM doc_stats d JOIN moves m ON d.doc_id = m.doc_id",
        "tokens unigram surprisal doc_stats near", "moves AS (SELECT doc_id, avg(abs(s - prev)) AS masd, sum((s - mean) * (prev - mean)) / (sum((s - mean) * (s - mean)) + 1e-12) AS acf1, avg(CASE WHEN s >= mean + sd THEN 1.0 ELSE 0.0 END) AS spikes FROM near GROUP BY doc_id)",
    ),
    "spike_context": S(
        "SELECT doc_id, count(*) AS spikes, round(avg(CASE WHEN MATCHES(prev_tok, R'[\\p{L}\\p{N}]') = 0 THEN 1.0 ELSE 0.0 END), 6) AS prev_punct_rate, round(avg(CASE WHEN MATCHES(next_tok, R'\\p{L}') >= 3 THEN 1.0 ELSE 0.0 END), 6) AS next_content_rate, round(avg(s - mean), 6) AS excess FROM near WHERE s >= mean + sd AND prev_tok IS NOT NULL AND next_tok IS NOT NULL GROUP BY doc_id",
        "tokens unigram surprisal doc_stats near",
    ),
    "spike_highlights": S("SELECT doc_id, idx, tok, round(s, 6) AS surprisal, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, idx) AS k FROM surprisal) x WHERE k <= 12", "tokens unigram surprisal"),
    "segment_burst": S(
        "SELECT doc_id, count(*) AS segments, round(stddev_pop(m) / (abs(avg(m)) + 1e-12), 6) AS burst_cv, round(stddev_pop(n) / (abs(avg(n)) + 1e-12), 6) AS len_cv FROM (SELECT doc_id, line_no, avg(s) AS m, CAST(count(*) AS DOUBLE) AS n FROM placed GROUP BY doc_id, line_no) x GROUP BY doc_id HAVING count(*) >= 2",
        "tokens unigram surprisal", "placed AS (SELECT doc_id, s, sum(MATCHES(tok, R'\\n')) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS line_no FROM surprisal)",
    ),
    "nucleus_width": S(
        "SELECT count(CASE WHEN before < 0.9 THEN 1 END) AS width, count(*) AS vocabulary FROM (SELECT c / n - c / n + coalesce(sum(c / n) OVER (ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM unigram CROSS JOIN size) x",
        "tokens unigram",
    ),
    "author_rollup": S("SELECT source, count(*) AS docs_count, CAST(sum(n) AS BIGINT) AS tokens_total, round(avg(mean), 6) AS surprisal_mean_mean, round(avg(sd), 6) AS surprisal_sd_mean, round(avg(p90), 6) AS surprisal_p90_mean FROM doc_stats GROUP BY source", "tokens unigram surprisal doc_stats"),
}

_NEXT = "z AS (SELECT *, lag(s) OVER w AS prev, lead(s) OVER w AS next, lag(s, 2) OVER w AS prev2, avg(s) OVER (PARTITION BY user_id) AS mean, stddev_pop(s) OVER (PARTITION BY user_id) AS sd, count(*) OVER (PARTITION BY user_id) AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY idx))"
_RUNS = "islands AS (SELECT user_id, high, count(*) AS len FROM (SELECT user_id, high, idx - row_number() OVER (PARTITION BY user_id, high ORDER BY idx) AS island FROM flagged) f GROUP BY user_id, high, island)"
SERIES = {
    "peaks_ipi": S("SELECT user_id, count(*) AS peaks, round(avg(gap), 6) AS ipi_mean, round(PCT(gap, 0.5), 6) AS ipi_p50, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) AS ipi_cv FROM (SELECT user_id, CAST(idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS DOUBLE) AS gap FROM z WHERE s >= mean + sd AND s > prev AND s >= next) p GROUP BY user_id", "series", _NEXT),
    "runs_median": S("SELECT user_id, round(avg(CASE WHEN high = 0 THEN len END), 6) AS run_low, round(avg(CASE WHEN high = 1 THEN len END), 6) AS run_high FROM islands GROUP BY user_id", "series", "flagged AS (SELECT x.user_id, x.idx, CASE WHEN x.s > m.med THEN 1 ELSE 0 END AS high FROM series x JOIN (SELECT user_id, PCT(s, 0.5) AS med FROM series GROUP BY user_id) m ON x.user_id = m.user_id), " + _RUNS),
    "runs_q90": S("SELECT user_id, count(*) AS runs, round(avg(len), 6) AS run_mean, CASE WHEN count(*) >= 5 THEN round(PCT(len, 0.9), 6) ELSE round(CAST(max(len) AS DOUBLE), 6) END AS run_q90 FROM islands WHERE high = 1 GROUP BY user_id", "series", "flagged AS (SELECT x.user_id, x.idx, CASE WHEN x.s >= m.q THEN 1 ELSE 0 END AS high FROM series x JOIN (SELECT user_id, PCT(s, 0.9) AS q FROM series GROUP BY user_id) m ON x.user_id = m.user_id), " + _RUNS),
    "valleys_p30": S("SELECT user_id, count(*) AS valleys, max(len) AS longest FROM islands WHERE high = 1 AND len >= 4 GROUP BY user_id", "series", "flagged AS (SELECT x.user_id, x.idx, CASE WHEN x.s < m.q THEN 1 ELSE 0 END AS high FROM series x JOIN (SELECT user_id, PCT(s, 0.3) AS q FROM series GROUP BY user_id) m ON x.user_id = m.user_id), " + _RUNS),
    "acf_lags": S("SELECT user_id, " + ", ".join(f"round(sum((s - mean) * (l{k} - mean)) / (sum((s - mean) * (s - mean)) + 1e-12), 6) AS acf{k}" for k in range(1, 11)) + " FROM lagged GROUP BY user_id", "series", "lagged AS (SELECT user_id, s, avg(s) OVER (PARTITION BY user_id) AS mean, " + ", ".join(f"lag(s, {k}) OVER w AS l{k}" for k in range(1, 11)) + " FROM series WINDOW w AS (PARTITION BY user_id ORDER BY idx))"),
    "perm_entropy": S("SELECT user_id, round((0 - sum(c / n * ln(c / n))) / ln(6), 6) AS perm_entropy FROM (SELECT user_id, p, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS n FROM (SELECT user_id, CASE WHEN prev2 <= prev THEN 4 ELSE 0 END + CASE WHEN prev <= s THEN 2 ELSE 0 END + CASE WHEN prev2 <= s THEN 1 ELSE 0 END AS p FROM z WHERE prev2 IS NOT NULL) q GROUP BY user_id, p) r GROUP BY user_id", "series", _NEXT),
    "hurst_rs": S(
        "SELECT user_id, round(regr_slope(ln(rs), ln(size)), 6) AS hurst FROM (SELECT user_id, size, avg((hi - lo) / (sd + 1e-12)) AS rs FROM (SELECT user_id, size, block, max(y) AS hi, min(y) AS lo, max(sd) AS sd FROM walks GROUP BY user_id, size, block) b GROUP BY user_id, size) r WHERE rs > 0 GROUP BY user_id HAVING count(*) >= 2",
        "series", "sizes AS (SELECT 8 AS size UNION ALL SELECT 16 UNION ALL SELECT 32 UNION ALL SELECT 64 UNION ALL SELECT 128 UNION ALL SELECT 256 UNION ALL SELECT 512), lens AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id HAVING count(*) >= 64), blocks AS (SELECT x.user_id, z.size, CAST(floor(x.idx / z.size) AS BIGINT) AS block, x.idx, x.s FROM series x JOIN lens l ON x.user_id = l.user_id JOIN sizes z ON 2 * z.size <= l.n WHERE x.idx < floor(l.n / z.size) * z.size), centred AS (SELECT *, s - avg(s) OVER (PARTITION BY user_id, size, block) AS c, stddev_pop(s) OVER (PARTITION BY user_id, size, block) AS sd FROM blocks), walks AS (SELECT user_id, size, block, sd, sum(c) OVER (PARTITION BY user_id, size, block ORDER BY idx ROWS UNBOUNDED PRECEDING) AS y FROM centred)",
    ),
    "momentum_frontloading": S("SELECT user_id, round(corr(CAST(idx AS DOUBLE), s), 6) AS momentum, round(greatest(-1.0, least(1.0, (max(n) / 2.0 - PCT(CASE WHEN s >= mean + sd THEN CAST(idx AS DOUBLE) END, 0.5)) / (max(n) / 2.0))), 6) AS front_loading FROM z GROUP BY user_id HAVING count(*) >= 3 AND count(CASE WHEN s >= mean + sd THEN 1 END) > 0", "series", _NEXT),
    "moving_average5": S("SELECT user_id, idx, round(sum(s) OVER w / 5, 6) AS ma5, round(avg(s) OVER w, 6) AS local_mean FROM series WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "series"),
    "cooldown_frame": S("SELECT user_id, count(*) AS spikes, round(avg(s - after), 6) AS cooldown_drop_3 FROM (SELECT user_id, s, mean, sd, avg(s) OVER w AS after, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) c WHERE s >= mean + sd AND k = 3 GROUP BY user_id", "series", _NEXT),
    "series_moments": S("SELECT user_id, count(*) AS n, round(sum(power(s - mean, 3)) / count(*) / power(max(sd), 3), 6) AS skewness, round(sum(power(s - mean, 4)) / count(*) / power(max(sd), 4) - 3, 6) AS kurtosis, round(PCT(s, 0.75) - PCT(s, 0.25), 6) AS iqr, round(max(sd) / nullif(max(mean), 0), 6) AS cv, round(avg(abs(s - prev)), 6) AS masd FROM z WHERE sd > 1e-12 GROUP BY user_id HAVING count(*) >= 4", "series", _NEXT),
    "tail_index": S("SELECT x.user_id, round(avg(ln(x.s / (m.q + 1e-12) + 1e-12)), 6) AS tail_index FROM series x JOIN (SELECT user_id, PCT(s, 0.9) AS q FROM series GROUP BY user_id) m ON x.user_id = m.user_id WHERE x.s >= m.q AND m.q > 0 GROUP BY x.user_id HAVING count(*) >= 5", "series"),
    "chunk_signature": S("SELECT user_id, CAST(floor(idx / 25) AS BIGINT) AS chunk, count(*) AS n, " + ", ".join(f"round(PCT(s, {q}), 6) AS q{int(q * 100):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM series GROUP BY user_id, CAST(floor(idx / 25) AS BIGINT) HAVING count(*) >= 10", "series"),
    "interval_merge": S(
        "SELECT user_id, min(a) AS first, max(b) AS last, count(*) AS merged FROM (SELECT user_id, a, b, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM spans) m) i GROUP BY user_id, island",
        "series", "spans AS (SELECT user_id, idx AS a, idx + CAST(floor(abs(s)) AS BIGINT) % 4 AS b FROM series)",
    ),
    "zscore": S("SELECT user_id, idx, round((s - avg(s) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(s) OVER (PARTITION BY user_id) < 1e-8 THEN 1.0 ELSE stddev_pop(s) OVER (PARTITION BY user_id) END, 6) AS z FROM series", "series"),
}

CORPUS = {
    "sample_ids": S("SELECT seq, substr(sha1(concat(source, NUL, title, NUL, url, NUL, text)), 1, 12) AS sample_id, sha1(concat(source, NUL, title, NUL)) AS stable_id, concat(source, ':', substr(sha1(title), 1, 12)) AS group_id FROM samples", "samples"),
    "dedup_text": S("SELECT seq, k AS kept FROM (SELECT seq, row_number() OVER (PARTITION BY sha1(lower(trim(regexp_replace(text, R'[ \\n\\t]+', ' 'SLUG)))) ORDER BY seq) AS k FROM samples) x WHERE k = 1", "samples"),
    "compaction_last": S("SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1"),
    "group_split": S(
        "SELECT source, group_id, CASE WHEN n = 1 THEN 'test' WHEN n = 2 AND k = 1 THEN 'train' WHEN n = 2 THEN 'test' WHEN k <= least(n - 2, greatest(1, EVEN(n * 0.7))) THEN 'train' WHEN k <= least(n - 1, greatest(1, EVEN(n * 0.7)) + greatest(1, EVEN(n * 0.15))) THEN 'val' ELSE 'test' END AS split FROM (SELECT source, group_id, row_number() OVER (PARTITION BY source ORDER BY sha1(concat('1337', NUL, group_id)), group_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, group_id FROM samples) g) x",
        "samples",
    ),
    "split_manifest": S("SELECT source, count(*) AS samples, count(DISTINCT group_id) AS groups, count(DISTINCT CASE WHEN b < 70 THEN group_id END) AS train_groups FROM (SELECT source, group_id, HEX8(group_id) % 100 AS b FROM samples) x GROUP BY source", "samples"),
    "pair_unpivot": S("SELECT k, chosen_id AS doc_id, 1 AS label FROM pairs UNION ALL SELECT k, rejected_id AS doc_id, 0 AS label FROM pairs", "pairs"),
    "job_grid": S("SELECT j.doc_id, j.tier, HEX8(job) % 3 AS provider, CASE WHEN l.doc_id IS NULL THEN 'unresolved' ELSE 'done' END AS status FROM (SELECT d.doc_id, t.tier, concat(CAST(d.doc_id AS VARCHAR(20)), NUL, t.tier) AS job FROM documents d CROSS JOIN tiers t) j LEFT JOIN labels l ON j.doc_id = l.doc_id", "", "tiers AS (SELECT 'plain' AS tier UNION ALL SELECT 'guided' UNION ALL SELECT 'strict')"),
    "resume_anti_join": S("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL"),
    "word_chunks": S("SELECT doc_id, CAST(floor(idx / 500) AS BIGINT) AS chunk, count(*) AS n, count(DISTINCT v) AS n_distinct FROM words GROUP BY doc_id, CAST(floor(idx / 500) AS BIGINT) HAVING count(*) >= 50", "words"),
}

_POS = "ordered AS (SELECT y, x, row_number() OVER (ORDER BY x, doc_id) AS r, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS t, rank() OVER (ORDER BY y, doc_id) AS ry FROM labelled)"
EVALUATION = {
    "baseline_summary": S(
        "SELECT slice, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, " + ", ".join(f"round(PCT(x, {q}), 6) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM sliced GROUP BY slice",
        "corpus", "sliced AS (SELECT doc_type AS slice, CAST(length(text) AS DOUBLE) AS x FROM corpus WHERE doc_type <> 'prose' UNION ALL SELECT 'prose', CAST(length(text) AS DOUBLE) FROM corpus WHERE doc_type IN ('novel', 'shortstory') UNION ALL SELECT 'all', CAST(length(text) AS DOUBLE) FROM corpus)",
    ),
    "baseline_percentile": S("SELECT doc_id, round(100.0 * cume_dist() OVER (PARTITION BY doc_type ORDER BY length(text)), 6) AS percentile FROM corpus", "corpus"),
    "metric_score": S("SELECT doc_id, round(CASE WHEN p < 25 THEN p / 25 WHEN p <= 75 THEN 1.0 WHEN p <= 90 THEN 1 + 0.08 * (p - 75) / 15 ELSE 1.08 * (100 - p) / 10 END, 6) AS score FROM (SELECT doc_id, 100.0 * cume_dist() OVER (ORDER BY length(text)) AS p FROM corpus) x", "corpus"),
    "score_summary_by_source": S("SELECT source, count(*) AS n, round(avg(x), 6) AS mean, round(PCT(x, 0.1), 6) AS p10, round(PCT(x, 0.5), 6) AS p50, round(PCT(x, 0.9), 6) AS p90, min(x) AS least, max(x) AS most FROM (SELECT source, n_chars AS x FROM documents) d GROUP BY source"),
    "topk_by_source": S("SELECT source, doc_id, top, bottom FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS top, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS bottom FROM documents) d WHERE top <= 3 OR bottom <= 3"),
    "effect_sizes": S("SELECT round((avg(CASE WHEN y = 1 THEN x END) - avg(CASE WHEN y = 0 THEN x END)) / sqrt(((count(CASE WHEN y = 1 THEN 1 END) - 1) * var_samp(CASE WHEN y = 1 THEN x END) + (count(CASE WHEN y = 0 THEN 1 END) - 1) * var_samp(CASE WHEN y = 0 THEN x END)) / (count(*) - 2)), 6) AS cohens_d FROM labelled", "labelled"),
    "overlap_coef": S("SELECT round(sum(least(p, q)), 6) AS overlap FROM (SELECT bin, count(CASE WHEN y = 1 THEN 1 END) / max(n1) AS p, count(CASE WHEN y = 0 THEN 1 END) / max(n0) AS q FROM (SELECT y, least(99, CAST(floor(100.0 * (x - lo) / (hi - lo)) AS BIGINT)) AS bin, n1, n0 FROM labelled CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM labelled) e) b GROUP BY bin) c", "labelled"),
    "auc_ordinal": S("SELECT round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM ordered CROSS JOIN (SELECT sum(y) AS p, count(*) AS n FROM labelled) e GROUP BY p, n", "labelled", _POS),
    "auc_ties": S("SELECT round((sum(CASE WHEN y = 1 THEN t END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM ordered CROSS JOIN (SELECT sum(y) AS p, count(*) AS n FROM labelled) e GROUP BY p, n", "labelled", _POS),
    "correlations": S("SELECT round(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) AS pearson, round(corr(CAST(r AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman FROM ordered", "labelled", _POS),
    "pair_margins": S("SELECT round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(m), 6) AS mean, round(PCT(m, 0.1), 6) AS p10, round(PCT(m, 0.5), 6) AS p50, round(PCT(m, 0.9), 6) AS p90 FROM (SELECT CAST(chosen_x - rejected_x AS DOUBLE) AS m FROM pairs) p", "pairs"),
    "error_measures": S("SELECT round(avg(power(y - p, 2)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae FROM (SELECT y, 1 / (1 + exp(-(x - 2000) / 1000.0)) AS p FROM labelled) e", "labelled"),
    "target_bands": S("SELECT doc_type, round(PCT(length(text), 0.25), 6) AS p25, round(avg(length(text)), 6) AS mean, round(PCT(length(text), 0.75), 6) AS p75 FROM corpus GROUP BY doc_type", "corpus"),
}

MORE = {
    "token_surprisal": S("SELECT doc_id, idx, round(s, 6) AS surprisal, round(s / ln(2e0), 6) AS bits, k AS rank FROM surprisal x JOIN (SELECT v, rank() OVER (ORDER BY c DESC) AS k FROM unigram) r ON x.tok = r.v", "tokens unigram surprisal"),
    "unigram_entropy": S("SELECT round(0 - sum(p * ln(p)), 6) AS entropy, round(exp(0 - sum(p * ln(p))), 4) AS effective_support, round(sum(CASE WHEN k <= 10 THEN p END), 6) AS top10_mass, round(1 - sum(CASE WHEN k <= 10 THEN p END), 6) AS tail_mass FROM (SELECT c / n AS p, row_number() OVER (ORDER BY c DESC, v) AS k FROM (SELECT v, CAST(c AS DOUBLE) AS c, CAST(n AS DOUBLE) AS n FROM unigram CROSS JOIN size) u) x", "tokens unigram"),
    "bigram_entropy": S(
        "SELECT a, count(*) AS seen, round(0 - sum(c / n * ln(c / n)), 6) AS entropy, max_by(b, c * 1e6 + k) AS likeliest FROM (SELECT a, b, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY a) AS DOUBLE) AS n, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM bigrams) x GROUP BY a",
        "tokens", "follow AS (SELECT doc_id, v AS a, lead(v) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM tokens), bigrams AS (SELECT a, b, count(*) AS c FROM follow WHERE b IS NOT NULL GROUP BY a, b)",
    ),
    "paragraph_cadence": S(
        "SELECT doc_id, line_no AS paragraph, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s) / nullif(avg(s), 0), 6) AS cv, round(corr(CAST(idx AS DOUBLE), s), 6) AS momentum FROM placed GROUP BY doc_id, line_no HAVING count(*) >= 5 AND stddev_pop(s) > 1e-9",
        "tokens unigram surprisal", "placed AS (SELECT doc_id, idx, s, sum(MATCHES(tok, R'\\n')) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS line_no FROM surprisal)",
    ),
    "windowed_cadence": S("SELECT doc_id, win, count(*) AS n, round(avg(s), 6) AS mean, round(avg(s) - avg(avg(s)) OVER (PARTITION BY doc_id), 6) AS relative FROM (SELECT doc_id, s, CAST(floor(idx / 128) AS BIGINT) AS win FROM surprisal) w GROUP BY doc_id, win", "tokens unigram surprisal"),
    "windowed_weighted_mean": S("SELECT doc_id, round(sum(w * m) / sum(w), 6) AS score, round(max(CASE WHEN w >= 0.25 THEN m END), 6) AS best, round(min(CASE WHEN w >= 0.25 THEN m END), 6) AS worst FROM (SELECT doc_id, CAST(floor(idx / 128) AS BIGINT) AS win, avg(s) AS m, greatest(0.05, least(1.0, count(*) / 128.0)) AS w FROM surprisal GROUP BY doc_id, CAST(floor(idx / 128) AS BIGINT)) x GROUP BY doc_id", "tokens unigram surprisal"),
    "dead_zones": S(
        "SELECT doc_id, island, min(idx) AS first, max(idx) + 2 AS last, count(*) AS windows FROM (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM flat WHERE k = 3 AND sd <= greatest(0.5, 0.25 * whole)) f GROUP BY doc_id, island",
        "sentences", "sized AS (SELECT doc_id, idx, CAST(MATCHES(v, R'[A-Za-z]+') AS DOUBLE) AS n FROM sentences), flat AS (SELECT doc_id, idx, stddev_pop(n) OVER w AS sd, count(*) OVER w AS k, stddev_pop(n) OVER (PARTITION BY doc_id) AS whole FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))",
    ),
    "type_coercion": S("SELECT doc_id, CASE lang WHEN 'en' THEN 'prose' WHEN 'fr' THEN 'poem' WHEN 'de' THEN 'novel' ELSE 'shortstory' END AS doc_type, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1 WHEN source IN ('src3', 'src4') THEN 0 END AS label FROM documents"),
    "primary_score_select": S("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'trained' WHEN d.n_chars >= 1000 THEN 'rubric' ELSE 'none' END AS origin, coalesce(CAST(100 * l.quality AS DOUBLE), CASE WHEN d.n_chars >= 1000 THEN least(100.0, d.n_chars / 100.0) END) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "negations_numbers": S("SELECT doc_id, MATCHES(lower(text), R'(^|[^a-z])(not|no|never|none|nor)([^a-z]|$)') AS negations, MATCHES(text, R'[0-9]+([.][0-9]+)?%?') AS numbers FROM (SELECT doc_id, text FROM documents) d"),
    "middle_slice": S("SELECT doc_id, CASE WHEN n >= 25000 THEN substr(text, CAST(floor(n * 0.05) AS INT) + 1, CAST(floor(n * 0.95) AS INT) - CAST(floor(n * 0.05) AS INT)) ELSE text END AS part FROM (SELECT doc_id, text, length(text) AS n FROM documents) d"),
    "excerpts": S("SELECT doc_id, substr(text, 1, 48) AS head, CASE WHEN length(text) > 48 THEN concat(substr(text, 1, 48), '…') ELSE text END AS shown FROM documents"),
    "topic_hint": S("SELECT doc_id, v AS first_sentence, MATCHES(v, R'[A-Za-z]+') AS n_words FROM sentences WHERE idx = 0", "sentences"),
    "representative_doc": S("SELECT doc_type, doc_id FROM (SELECT c.doc_type, c.doc_id, row_number() OVER (PARTITION BY c.doc_type ORDER BY abs(length(c.text) - m.med), c.doc_id) AS k FROM corpus c JOIN (SELECT doc_type, PCT(length(text), 0.5) AS med FROM corpus GROUP BY doc_type) m ON c.doc_type = m.doc_type) r WHERE k = 1", "corpus"),
    "latest_by_kind": S("SELECT event_type, event_id, k FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) e WHERE k <= 3"),
    "score_histogram": S("SELECT doc_type, CAST(floor(ln(length(text) + 1)) AS BIGINT) AS bin, count(*) AS n FROM corpus GROUP BY doc_type, CAST(floor(ln(length(text) + 1)) AS BIGINT)", "corpus"),
    "type_delta": S("SELECT doc_type, round(avg(CASE WHEN lang = 'en' THEN length(text) END) - avg(CASE WHEN lang <> 'en' THEN length(text) END), 6) AS delta FROM corpus GROUP BY doc_type", "corpus"),
    "skip_reasons": S("SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 200 THEN 'short' WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) d GROUP BY 1"),
    "mean_impute": S("SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY user_id), 0e0), 6) AS v FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) e"),
    "minmax_clamp": S("SELECT event_id, round(greatest(0.0, least(1.0, (value - lo) / nullif(hi - lo, 0))), 6) AS scaled FROM events CROSS JOIN (SELECT PCT(value, 0.1) AS lo, PCT(value, 0.9) AS hi FROM events) b"),
    "rating_upsert": S("SELECT user_id AS passage, count(*) AS ratings, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY user_id"),
    "group_leakage": S("SELECT count(*) AS groups, count(CASE WHEN splits > 1 THEN 1 END) AS leaking FROM (SELECT group_id, count(DISTINCT HEX8(group_id) % 10) AS splits FROM samples GROUP BY group_id) g", "samples"),
    "gibberish_share": S("SELECT source, round(avg(CASE WHEN ttr > 0.95 AND n > 50 THEN 1e0 ELSE 0e0 END), 6) AS share FROM (SELECT source, doc_id, count(DISTINCT v) / CAST(count(*) AS DOUBLE) AS ttr, count(*) AS n FROM words GROUP BY source, doc_id) w GROUP BY source", "words"),
}

ALL = {**TEXT, **TOKENS, **SERIES, **CORPUS, **EVALUATION, **MORE, **PROSE}
