"""Spikes, coherence, texture, corpora and pages as statements; each value follows the definition that its comment names."""

from __future__ import annotations

from .dialect import Statement as S

#: Function words by which tokens are classed.
FUNCTION_WORDS = """a an the and or but if then else when while for nor so yet at by from in
    of on to up with as is are was were be been being do does did have has had
    i me my we us our you your he him his she her it its they them their this
    that which what where when why how not no""".split()
#: Words that are no content tokens.
PLAIN_WORDS = (
    "a an the and or but if then else when while for of in on to with as is are was were be been being do does did have has had i me my we us our you your "
    "he him his she her it its they them their this that these those who whom which what where why how not no only also very just too"
).split()
#: Common words that coherence and distinctiveness leave out.
COMMON_WORDS = (
    "a an the and or but if then else when while for nor so yet about above below under over into out upon with without within across around between among through during before after where what who which how why whose this that these those here there ever never always often sometimes "
    "usually would could should might must can may"
).split()
_view = lambda name, words: f"{name} AS (SELECT DISTINCT w FROM (VALUES " + ", ".join(f"('{w}')" for w in words) + ") t(w))"
STOP_VIEW, COMMON_VIEW, PLAIN_VIEW = _view("stops", FUNCTION_WORDS), _view("stops", COMMON_WORDS), _view("stops", PLAIN_WORDS)

#: Tokens with their sentence, their place in it and its length; a sentence ends with a token that holds an end mark.
PLACED = (
    "placed AS (SELECT doc_id, idx, v, sent, row_number() OVER (PARTITION BY doc_id, sent ORDER BY idx) - 1 AS rel, count(*) OVER (PARTITION BY doc_id, sent) AS len "
    "FROM (SELECT doc_id, idx, v, coalesce(sum(CASE WHEN MATCHES(v, R'[.!?]') > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tokens) x)"
)
#: Tokens a standard deviation or more above their text's mean, by kind of token and place in the sentence.
SPIKES = (
    "spikes AS (SELECT n.doc_id, n.idx, n.tok, n.s, n.s - n.mean AS delta, n.n, CASE WHEN MATCHES(n.tok, R'[\\p{L}\\p{N}]') = 0 THEN 'punctuation' WHEN t.w IS NOT NULL OR length(n.word) <= 2 THEN 'function' ELSE 'content' END AS kind, "
    "CASE WHEN p.len <= 2 THEN 'middle' WHEN p.rel <= 1 THEN 'start' WHEN p.rel >= p.len - 2 THEN 'end' ELSE 'middle' END AS place "
    "FROM (SELECT doc_id, idx, tok, s, mean, sd, n, regexp_replace(lower(tok), R'[^\\p{L}]', ''SLUG) AS word FROM near) n "
    "JOIN placed p ON p.doc_id = n.doc_id AND p.idx = n.idx + 1 LEFT JOIN stops t ON t.w = n.word WHERE n.s >= n.mean + n.sd)"
)
TOKENS = "tokens unigram surprisal doc_stats near"
#: Mean surprisal of each text by two scorers: shares of tokens, and of tokens after the one before.
SCORERS = (
    "two AS (SELECT doc_id, source, idx, v, lag(v) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM tokens), "
    "bigrams AS (SELECT before, v, count(*) AS c FROM two WHERE before IS NOT NULL GROUP BY before, v), contexts AS (SELECT before, sum(c) AS c FROM bigrams GROUP BY before), "
    "scored AS (SELECT t.doc_id, t.source, avg(-ln((u.c + 1.0) / (z.n + z.k + 1.0))) AS one, avg(-ln((b.c + 1.0) / (x.c + z.k + 1.0))) AS two "
    "FROM two t JOIN unigram u ON u.v = t.v JOIN bigrams b ON b.before = t.before AND b.v = t.v JOIN contexts x ON x.before = t.before CROSS JOIN size z GROUP BY t.doc_id, t.source)"
)
#: Words of sentences, without stop words, each once a sentence.
HELD = "held AS (SELECT DISTINCT s.doc_id, s.idx, s.w FROM sentwords s LEFT JOIN stops t ON t.w = s.w WHERE t.w IS NULL)"
#: Words of turns and of the turns before.
SAID = "said AS (SELECT DISTINCT c.conv_id, c.turn, c.w FROM turnwords c LEFT JOIN stops t ON t.w = c.w WHERE t.w IS NULL)"
#: Numbers and negations of a turn.
FACTS = "facts AS (SELECT DISTINCT conv_id, turn, kind, w FROM turnfacts)"
#: Score before, probability of an anti-pattern, hard threshold and weight; thresholds and exponents are fixed values.
RISK = (
    "risk AS (SELECT event_id, base, p, hard, w, greatest(0.45, least(0.65, hard - 0.30)) AS soft FROM (SELECT event_id, CAST(abs(value) AS DOUBLE) % 101.0 AS base, (CAST(abs(value) AS DOUBLE) * 7.0 % 100.0) / 100.0 AS p, 0.85 AS hard, 1.0 AS w FROM events) e)"
)
HOST = "regexp_extract(lower(url), R'^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"

PROSE = {
    # kinds and places of spikes, and how far they lie apart
    "spike_patterns": S("SELECT doc_id, idx, kind, place, round(s, 6) AS surprisal, round(delta, 6) AS delta FROM spikes", TOKENS, f"{STOP_VIEW}, {PLACED}, {SPIKES}"),
    "spike_stats": S(
        "SELECT doc_id, count(*) AS spikes, round(100.0 * count(*) / max(n), 6) AS rate, " + ", ".join(f"count(CASE WHEN place = '{p}' THEN 1 END) AS at_{p}" for p in ("start", "middle", "end")) + ", "
        + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in ("content", "function", "punctuation"))
        + ", round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS sd, round(avg(delta), 6) AS delta, round(coalesce(avg(gap), 0.0), 6) AS ipi_mean, round(coalesce(stddev_pop(gap), 0.0), 6) AS ipi_sd, "
        "round(coalesce(PCT(gap, 0.5), 0.0), 6) AS ipi_median, round(coalesce(0.3 * avg(gap), 0.0), 6) AS cooldown FROM (SELECT *, CAST(idx - lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS DOUBLE) AS gap FROM spikes) g GROUP BY doc_id",
        TOKENS, f"{STOP_VIEW}, {PLACED}, {SPIKES}",
    ),
    # measures of a text by the shares of tokens, and how open each place is by the tokens that follow the one before it
    "cadence_metrics": S(
        "SELECT a.doc_id, round(a.h, 6) AS entropy_mean, round(a.rate, 6) AS high_surprise_rate_per_100, round(a.ipi, 6) AS ipi_mean, round(a.cooldown, 6) AS cooldown_entropy_drop_3, round(b.cv, 6) AS sent_burst_cv, round(c.cv, 6) AS para_burst_cv, "
        "round(a.next_content, 6) AS spike_next_content_rate, round(a.prev_punct, 6) AS spike_prev_punct_rate, round(a.content, 6) AS content_fraction FROM "
        "(SELECT doc_id, avg(h) AS h, 100.0 * count(CASE WHEN up = 1 AND s > prev AND s >= next THEN 1 END) / max(n) AS rate, CASE WHEN sum(up) >= 2 THEN 1.0 * (max(CASE WHEN up = 1 THEN idx END) - min(CASE WHEN up = 1 THEN idx END)) / (sum(up) - 1) END AS ipi, "
        "avg(CASE WHEN up = 1 AND idx + 3 < n THEN h - after END) AS cooldown, coalesce(avg(CASE WHEN up = 1 AND next_tok IS NOT NULL THEN CASE WHEN MATCHES(next_tok, R'\\p{L}') >= 3 THEN 1.0 ELSE 0.0 END END), 0.0) AS next_content, "
        "coalesce(avg(CASE WHEN up = 1 AND prev_tok IS NOT NULL THEN CASE WHEN MATCHES(prev_tok, R'[\\p{L}\\p{N}]') = 0 THEN 1.0 ELSE 0.0 END END), 0.0) AS prev_punct, avg(CASE WHEN MATCHES(tok, R'\\p{L}') >= 3 THEN 1.0 ELSE 0.0 END) AS content FROM flat GROUP BY doc_id) a "
        "LEFT JOIN (SELECT doc_id, stddev_pop(m) / (abs(avg(m)) + 1e-12) AS cv FROM (SELECT doc_id, sent, avg(s) AS m FROM flat GROUP BY doc_id, sent) x GROUP BY doc_id HAVING count(*) >= 2) b ON b.doc_id = a.doc_id "
        "LEFT JOIN (SELECT doc_id, stddev_pop(m) / (abs(avg(m)) + 1e-12) AS cv FROM (SELECT doc_id, para, avg(s) AS m FROM flat GROUP BY doc_id, para) x GROUP BY doc_id HAVING count(*) >= 2) c ON c.doc_id = a.doc_id",
        TOKENS,
        "places AS (SELECT doc_id, idx - 1 AS idx, v, lag(v) OVER w AS before, coalesce(sum(CASE WHEN MATCHES(v, R'[.!?\\n]') > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent, "
        "coalesce(sum(MATCHES(v, R'\\n\\s*\\n')) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), "
        "grams AS (SELECT before, v, CAST(count(*) AS DOUBLE) AS c FROM places WHERE before IS NOT NULL GROUP BY before, v), openness AS (SELECT before, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM grams GROUP BY before), "
        "steps AS (SELECT p.doc_id, p.idx, p.sent, p.para, o.h, avg(o.h) OVER (PARTITION BY p.doc_id ORDER BY p.idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM places p JOIN openness o ON o.before = p.before), "
        "flat AS (SELECT n.doc_id, n.idx, n.tok, n.s, n.n, n.prev, n.next, n.prev_tok, n.next_tok, t.h, t.after, t.sent, t.para, CASE WHEN n.s >= n.mean + n.sd THEN 1 ELSE 0 END AS up FROM near n JOIN steps t ON t.doc_id = n.doc_id AND t.idx = n.idx)",
    ),
    # the sentence that each spike lies in
    "spike_sentences": S("SELECT p.doc_id, p.sent, count(*) AS tokens, count(k.idx) AS spikes FROM placed p LEFT JOIN spikes k ON k.doc_id = p.doc_id AND k.idx + 1 = p.idx GROUP BY p.doc_id, p.sent", TOKENS, f"{STOP_VIEW}, {PLACED}, {SPIKES}"),
    # spikes of each line against 1.5 of max(4, length) tokens; runs of four or more cost
    "line_surprise": S(
        "SELECT doc_id, round(greatest(0.0, least(1.0, avg(exp(-abs(rate - target) / (target + 0.000001)) * (1 - CASE WHEN best >= 4 THEN least(1.0, 0.15 * (best - 3)) ELSE 0.0 END)))), 6) AS score FROM scored GROUP BY doc_id",
        TOKENS,
        "located AS (SELECT t.doc_id, t.idx, s.s, coalesce(sum(CASE WHEN position(chr(10) IN t.v) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM tokens t JOIN surprisal s ON s.doc_id = t.doc_id AND s.idx = t.idx - 1), "
        "z AS (SELECT doc_id, line, idx, CASE WHEN (s - avg(s) OVER w) / (stddev_pop(s) OVER w + 0.000001) > 1 THEN 1 ELSE 0 END AS up FROM located WINDOW w AS (PARTITION BY doc_id, line)), "
        "runs AS (SELECT doc_id, line, up, count(*) AS n FROM (SELECT doc_id, line, up, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) - row_number() OVER (PARTITION BY doc_id, line, up ORDER BY idx) AS island FROM z) i GROUP BY doc_id, line, up, island), "
        "scored AS (SELECT doc_id, line, 1.0 * sum(up * n) / sum(n) AS rate, 1.5 / greatest(4, sum(n)) AS target, max(up * n) AS best FROM runs GROUP BY doc_id, line HAVING sum(n) >= 3)",
    ),
    # sets of words of consecutive sentences
    "adjacent_jaccard": S(
        "SELECT doc_id, count(*) AS pairs, round(avg(shared / CAST(a + b - shared AS DOUBLE)), 6) AS overlap FROM (SELECT x.doc_id, x.idx, max(x.n) AS a, max(y.n) AS b, count(s.w) AS shared FROM sizes x JOIN sizes y ON y.doc_id = x.doc_id AND y.idx = x.idx + 1 "
        "LEFT JOIN (SELECT p.doc_id, p.idx, p.w FROM held p JOIN held q ON q.doc_id = p.doc_id AND q.idx = p.idx + 1 AND q.w = p.w) s ON s.doc_id = x.doc_id AND s.idx = x.idx GROUP BY x.doc_id, x.idx) z GROUP BY doc_id",
        "sentences sentwords", f"{COMMON_VIEW}, {HELD}, sizes AS (SELECT doc_id, idx, count(*) AS n FROM held GROUP BY doc_id, idx)",
    ),
    # share of a prompt's words that the next turn takes up
    "topic_overlap": S(
        "SELECT p.conv_id, p.turn, round(min(1.0 * coalesce(q.shared, 0) / n), 6) AS topic FROM (SELECT conv_id, turn, count(*) AS n FROM said GROUP BY conv_id, turn) p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 "
        "LEFT JOIN (SELECT a.conv_id, a.turn, count(*) AS shared FROM said a JOIN said b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.w = a.w GROUP BY a.conv_id, a.turn) q ON q.conv_id = p.conv_id AND q.turn = p.turn GROUP BY p.conv_id, p.turn",
        "turnwords", f"{COMMON_VIEW}, {SAID}",
    ),
    # the most frequent word's share beyond a tenth, five times
    "degeneration": S("SELECT doc_id, round(CASE WHEN sum(c) >= 10 THEN least(1.0, greatest(0.0, 5.0 * (1.0 * max(c) / sum(c) - 0.1))) ELSE 0.0 END, 6) AS penalty FROM (SELECT doc_id, v, count(*) AS c FROM words GROUP BY doc_id, v) w GROUP BY doc_id", "words"),
    # types and new pairs among words of five letters or more
    "distinctiveness": S(
        "SELECT doc_id, round(CASE WHEN n < 6 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.6 * least(1.0, types / n / 0.6) + 0.4 * least(1.0, pairs / greatest(1.0, n - 1) / 0.7))) END, 6) AS score FROM "
        "(SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT v) AS DOUBLE) AS types, CAST(count(DISTINCT CASE WHEN nxt IS NOT NULL THEN concat(v, ' ', nxt) END) AS DOUBLE) AS pairs FROM "
        "(SELECT w.doc_id, w.v, lead(w.v) OVER (PARTITION BY w.doc_id ORDER BY w.idx) AS nxt FROM words w LEFT JOIN stops t ON t.w = w.v WHERE length(w.v) >= 5 AND t.w IS NULL) c GROUP BY doc_id) d",
        "words", COMMON_VIEW,
    ),
    # from the last run of vowels on; the last three letters if that is shorter
    "rhyme_keys": S(
        "SELECT doc_id, idx, CASE WHEN length(k) >= 3 THEN k WHEN length(w) >= 3 THEN substr(w, length(w) - 2, 3) ELSE w END AS rhyme FROM (SELECT doc_id, idx, w, CASE WHEN MATCHES(w, R'[aeiouy]') = 0 THEN w ELSE regexp_extract(w, R'([aeiouy]+[^aeiouy]*)$', 1) END AS k FROM "
        "(SELECT doc_id, idx, regexp_replace(lower(regexp_extract(v, R'([A-Za-z]+)[^A-Za-z]*$', 1)), R'[^a-z]', ''SLUG) AS w FROM lines) l) m WHERE w <> ''",
        "lines",
    ),
    "format_penalty": S("SELECT doc_id, count(*) AS n_lines, CASE WHEN count(*) <> 14 THEN 1.0 ELSE 0.0 END AS penalty FROM lines GROUP BY doc_id", "lines"),
    # variation and movement of surprisal, bursts and lengths of sentences, types and repeats of words, weighted
    "texture_score": S(
        "SELECT a.doc_id, round(0.55 * a.cv + 0.15 * a.masd + 0.25 * coalesce(b.burst, 0.0) + 0.10 * coalesce(b.len_cv, 0.0) + 0.08 * coalesce(c.ttr, 0.0) - 0.70 * coalesce(c.tri, 0.0) - 0.35 * coalesce(c.adj, 0.0), 6) AS texture FROM "
        "(SELECT doc_id, max(sd) / nullif(max(mean), 0) AS cv, avg(abs(s - prev)) AS masd FROM near GROUP BY doc_id) a LEFT JOIN "
        "(SELECT doc_id, stddev_pop(m) / nullif(avg(m), 0) AS burst, stddev_pop(n) / nullif(avg(n), 0) AS len_cv FROM (SELECT p.doc_id, p.sent, avg(s.s) AS m, CAST(count(*) AS DOUBLE) AS n FROM placed p JOIN surprisal s ON s.doc_id = p.doc_id AND s.idx = p.idx - 1 GROUP BY p.doc_id, p.sent) x GROUP BY doc_id) b ON b.doc_id = a.doc_id LEFT JOIN "
        "(SELECT doc_id, 1.0 * count(DISTINCT v) / count(*) AS ttr, 1 - 1.0 * count(DISTINCT tri) / nullif(count(tri), 0) AS tri, avg(CASE WHEN v = nxt THEN 1.0 WHEN nxt IS NOT NULL THEN 0.0 END) AS adj FROM (SELECT doc_id, v, lead(v) OVER w AS nxt, CASE WHEN lead(v, 2) OVER w IS NOT NULL THEN concat(v, ' ', lead(v) OVER w, ' ', lead(v, 2) OVER w) END AS tri FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) t GROUP BY doc_id) c ON c.doc_id = a.doc_id",
        f"words {TOKENS}", PLACED,
    ),
    # windows of 512 tokens, each 384 after the one before; all tokens but the overlap are emitted once
    "token_windows": S("SELECT t.doc_id, t.idx AS start, least(t.idx + 512, z.n) AS stop, CASE WHEN t.idx = 0 THEN 0 ELSE t.idx + 128 END AS emit_from FROM tokens t JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) z ON z.doc_id = t.doc_id WHERE t.idx % 384 = 0 AND (t.idx = 0 OR t.idx + 128 < z.n)", "tokens"),
    # every 800 characters a window, from the line start before it
    "window_starts": S(
        "SELECT DISTINCT doc_id, begun AS start FROM (SELECT doc_id, target, max(line) OVER (PARTITION BY doc_id ORDER BY place, target ROWS UNBOUNDED PRECEDING) AS begun FROM (SELECT doc_id, line AS place, 0 AS target, line FROM bounds UNION ALL SELECT doc_id, k * 800 AS place, 1 AS target, CAST(NULL AS BIGINT) AS line FROM grid) u) w WHERE target = 1",
        "lines grid", "bounds AS (SELECT doc_id, CAST(coalesce(sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM lines)",
    ),
    # two scorers: by source, by text in 30 bins, and the sources that move most
    "model_compare": S("SELECT source, round(avg(one), 6) AS unigram, round(avg(two), 6) AS bigram, round(avg(two) - avg(one), 6) AS delta FROM scored GROUP BY source", "tokens unigram", SCORERS),
    "doc_delta_histogram": S(
        "SELECT bin, count(*) AS n FROM (SELECT least(29, CAST(floor(30.0 * (two - one - lo) / nullif(hi - lo, 0)) AS BIGINT)) AS bin FROM scored CROSS JOIN (SELECT min(two - one) AS lo, max(two - one) AS hi FROM scored) e) b GROUP BY bin", "tokens unigram", SCORERS
    ),
    "author_rankings": S("SELECT source, rank, round(m, 6) AS surprisal FROM (SELECT source, m, row_number() OVER (ORDER BY m, source) AS rank FROM (SELECT source, avg(mean) AS m FROM doc_stats GROUP BY source) a) r WHERE rank <= 10", "tokens unigram surprisal doc_stats"),
    # numbers, negations and names that a turn adds to or drops from the one before
    "entity_diffs": S(
        "SELECT conv_id, turn, count(CASE WHEN b IS NULL THEN 1 END) AS removed, count(CASE WHEN a IS NULL THEN 1 END) AS added, count(CASE WHEN (a IS NULL OR b IS NULL) AND kind = 'number' THEN 1 END) AS numbers, CASE WHEN count(CASE WHEN a IS NULL OR b IS NULL THEN 1 END) = 0 THEN 1 ELSE 0 END AS locked FROM "
        "(SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.turn, y.turn) AS turn, coalesce(x.kind, y.kind) AS kind, x.w AS a, y.w AS b FROM facts x FULL OUTER JOIN (SELECT conv_id, turn - 1 AS turn, kind, w FROM facts WHERE turn > 0) y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.kind = y.kind AND x.w = y.w) z GROUP BY conv_id, turn",
        "turnfacts", FACTS,
    ),
    # penalties below and above the hard threshold, and a cap that falls with the risk
    "penalty_adjust": S(
        "SELECT event_id, round(greatest(0.0, least(100.0, least(greatest(0.0, base - 20.0 * w * power(sr, 1.6) - 80.0 * w * power(hr, 1.1)), 100.0 - (100.0 - greatest(20.0, 100.0 - 70.0 * w)) * power(cr, 1.35)))), 6) AS adaptive, "
        "round(greatest(0.0, base - CASE WHEN p > hard THEN greatest(0.0, least(100.0, (p - hard) / greatest(0.000001, 1.0 - hard) * w * 100.0)) ELSE 0.0 END), 6) AS legacy FROM "
        "(SELECT *, greatest(0.0, least(1.0, (p - soft) / greatest(0.000001, hard - soft))) AS sr, greatest(0.0, least(1.0, (p - hard) / greatest(0.000001, 1.0 - hard))) AS hr, greatest(0.0, least(1.0, (p - soft) / greatest(0.000001, 1.0 - soft))) AS cr FROM risk) r",
        "", RISK,
    ),
    # all ordered pairs of a conversation's turns
    "pairwise_weights": S("SELECT a.conv_id, a.turn AS i, b.turn AS j, round(1 / (1 + exp(-(length(a.text) - length(b.text)) / 1000.0)), 6) AS weight FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn"),
    "group_advantage": S("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 10) AS advantage FROM events"),
    # rows of both tables; of equal texts the first by origin and id stays
    "mixed_union": S(
        "SELECT origin, id, sample_id, key FROM (SELECT origin, id, sample_id, key, row_number() OVER (PARTITION BY key ORDER BY origin, id) AS k FROM (SELECT origin, id, concat(origin, ':', CAST(id AS VARCHAR(20))) AS sample_id, concat('text:', sha1(text)) AS key FROM "
        "(SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark UNION ALL SELECT 'documents' AS origin, doc_id AS id, text FROM documents) u WHERE trim(text) <> '') s) x WHERE k = 1"
    ),
    # the first of each pair id, both texts not blank, groups split with truncated shares
    "consolidate_pairs": S(
        "SELECT p.pair_id, p.group_id, p.chosen_id, p.rejected_id, CASE WHEN g.k <= greatest(1, CAST(floor(g.n * 0.7) AS BIGINT)) THEN 'train' WHEN g.k <= greatest(1, CAST(floor(g.n * 0.7) AS BIGINT)) + greatest(1, CAST(floor(g.n * 0.15) AS BIGINT)) THEN 'val' ELSE 'test' END AS split FROM "
        "(SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS nth FROM ids) p JOIN (SELECT group_id, row_number() OVER (ORDER BY sha1(concat('1337', NUL, group_id)), group_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM ids) d) g ON g.group_id = p.group_id WHERE p.nth = 1",
        "pairs", "ids AS (SELECT substr(sha1(concat(CAST(chosen_id AS VARCHAR(20)), NUL, CAST(rejected_id AS VARCHAR(20)))), 1, 12) AS pair_id, k, group_id, chosen_id, rejected_id FROM pairs WHERE trim(chosen_text) <> '' AND trim(rejected_text) <> '')",
    ),
    "row_subsample": S("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1(concat('1337', NUL, CAST(doc_id AS VARCHAR(20)))), doc_id) AS k FROM documents) d WHERE k <= 20"),
    "bucket_filter": S("SELECT doc_id, source FROM documents WHERE lower(trim(lang)) = 'en'"),
    "label_precedence": S("SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), CASE WHEN d.lang = 'en' THEN 1.0 WHEN d.lang = 'fr' THEN 0.0 END) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE trim(d.text) <> '' AND (l.quality IS NOT NULL OR d.lang = 'en' OR d.lang = 'fr')"),
    "provider_choice": S("SELECT doc_id, HEX8(job) % 3 AS provider FROM (SELECT doc_id, concat('seed', NUL, CAST(doc_id AS VARCHAR(20))) AS job FROM documents) d"),
    # means over all rows of a source, those without the category included
    "category_means": S("SELECT d.source, count(*) AS n, round(100.0 * sum(coalesce(l.quality, 0)) / count(*), 6) AS quality, round(100.0 * sum(coalesce(l.toxic, 0)) / count(*), 6) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"),
    "probability_summary": S(
        "SELECT source, count(*) AS n, round(avg(p), 6) AS mean, " + ", ".join(f"round(CASE WHEN count(*) >= 2 THEN PCT(p, {q}) END, 6) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9))
        + ", round(avg(CASE WHEN y = 1 THEN p END), 6) AS mean_pos, round(avg(CASE WHEN y = 0 THEN p END), 6) AS mean_neg FROM (SELECT source, y, 1 / (1 + exp(-(x - 1500) / 1000.0)) AS p FROM labelled) s GROUP BY source",
        "labelled",
    ),
    # a part of one source's statistic and the rest of all sources'
    "author_merge": S("SELECT a.source, round(0.7 * a.m + 0.3 * b.m, 6) AS surprisal, round(0.7 * a.sd + 0.3 * b.sd, 6) AS sd FROM (SELECT source, avg(mean) AS m, avg(sd) AS sd FROM doc_stats GROUP BY source) a CROSS JOIN (SELECT avg(mean) AS m, avg(sd) AS sd FROM doc_stats) b", "tokens unigram surprisal doc_stats"),
    # http or https, no user, no local, private, link-local, multicast or reserved address
    # og:title goes before the title, wherever its attributes stand
    "page_titles": S(
        "SELECT page_id, title, og_title, CASE WHEN og_title <> '' THEN og_title ELSE title END AS best FROM (SELECT page_id, trim(regexp_extract(html, R'<title[^>]*>([^<]*)', 1)) AS title, "
        "trim(regexp_extract(regexp_extract(html, R'(?i)<meta[^>]*(?:property|name)=.?og:title[^>]*>', 0), R'(?i)content=.?([^\"]*)', 1)) AS og_title FROM pages) p"
    ),
    # tokens of three letters or more that are no plain words
    "content_tokens": S(
        "SELECT doc_id, count(*) AS tokens, count(CASE WHEN length(w) >= 3 AND t.w2 IS NULL THEN 1 END) AS content FROM (SELECT doc_id, regexp_replace(lower(v), R'[^\\p{L}]', ''SLUG) AS w FROM tokens) x LEFT JOIN (SELECT w AS w2 FROM stops) t ON t.w2 = x.w GROUP BY doc_id",
        "tokens", PLAIN_VIEW,
    ),
}
