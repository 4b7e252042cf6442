"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality import CHAR_LIMIT, LEAST_CHARS, LEAST_WORDS, SHARES, SHORT, WORD_LIMIT
from .quality import KINDS as CHARS
from .secrets import CANDIDATE, DISTINCT, KINDS, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]+"


def jaccard(n: int = 4, percent: int = 85) -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANKS}'), lambda x: x <> '') AS l FROM documents),
 sh AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < {n} THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - {n} + 2), lambda i: array_to_string(l[i:i + {n - 1}], ' '))) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))),
 ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reach AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n"""


def secrets(example_owners: int = 3, example_repositories: int = 6) -> str:
    rules = [(k, p.replace("(?i:", "(?i:").replace("'", "''"), g, least) for k, (_, _, p, g, least) in enumerate(RULES)] + [(len(RULES), CANDIDATE, 0, 0)]
    found = " UNION ALL ".join(f"SELECT doc_id, source, concat_ws('/', source, lang) AS repo, {k} AS kind, {least} AS least, string_split_regex(coalesce(text, ''), '{p}') AS gaps, regexp_extract_all(coalesce(text, ''), '{p}') AS f, regexp_extract_all(coalesce(text, ''), '{p}', {g}) AS h FROM documents" for k, p, g, least in rules)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    line = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return f"""WITH found AS ({found}), each AS (SELECT *, unnest(range(len(f))) AS i FROM found),
 spans AS (SELECT doc_id, source, repo, kind, least, h[i + 1] AS v, CAST(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0) AS BIGINT) AS start, length(f[i + 1]) AS l FROM each),
 placed AS (SELECT *, start + l AS stop FROM spans WHERE length(v) >= least), base AS (SELECT * FROM placed WHERE kind < {len(RULES)}),
 more AS (SELECT * FROM placed p WHERE kind = {len(RULES)} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {DISTINCT} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.start < p.stop AND p.start < b.stop)),
 owners AS (SELECT v, count(DISTINCT coalesce(source, '')) AS n, count(DISTINCT repo) AS r FROM (SELECT v, source, repo FROM base UNION ALL SELECT v, source, repo FROM more) GROUP BY v),
 class AS (SELECT v, n < {example_owners} AND r < {example_repositories} AS live FROM owners),
 every AS (SELECT doc_id, kind, start, stop, live FROM base JOIN class USING (v) UNION ALL SELECT m.doc_id, m.kind, m.start, m.stop, TRUE FROM more m JOIN owners o ON o.v = m.v WHERE o.n < {example_owners} AND o.r < {example_repositories})
 SELECT d.doc_id, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex, count(CASE WHEN kind < {len(RULES)} AND live THEN 1 END) AS n_live, count(CASE WHEN kind < {len(RULES)} AND NOT live THEN 1 END) AS n_example,
 sha256(coalesce(string_agg({line}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(RULES)}), '')) AS base_sha256, coalesce(string_agg({line}, ',' ORDER BY start, kind), '') AS spans FROM documents d LEFT JOIN every e ON e.doc_id = d.doc_id GROUP BY d.doc_id"""


def quality(common: int = 12) -> str:
    counts = ", ".join("len(regexp_extract_all(t, '" + p.replace("'", "''") + f"')) AS {k}" for k, p in CHARS.items())
    sums = ", ".join(f"sum({k} / chars::DOUBLE) AS {k}" for k in SHARES)
    means = ", ".join(f"round({k} / n, 9)" for k in SHARES)
    part = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(f'{p}[i]', f'({p}[i] + {q}[i]) / 2')} / 2 + {part(f'{q}[i]', f'({p}[i] + {q}[i]) / 2')} / 2))))"
    rest = lambda a: f"list_append({a}, greatest(0.0, 1 - coalesce(list_sum({a}), 0)))"
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
 c0 AS (SELECT *, len(w) AS words, length(array_to_string(w, '')) AS chars, {counts} FROM w), c AS (SELECT *, chars - ({" + ".join(CHARS)}) AS lower FROM c0),
 plain AS (SELECT * FROM c WHERE words >= 10 AND 100 * symbol <= chars AND 100 * bang <= 3 * chars AND 10 * upper <= 3 * chars),
 s AS (SELECT lang, count(*) AS n, sum(words)::DOUBLE AS words, {sums} FROM plain GROUP BY lang),
 v AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(list_transform(list_filter(w, lambda y: length(y) <= {SHORT}), lambda y: lower(y))) AS x FROM plain) WHERE regexp_matches(x, '^\p{{L}}+$') GROUP BY lang, x),
 top AS (SELECT lang, list(x ORDER BY c DESC, x)[1:{common}] AS xs, list(c ORDER BY c DESC, x)[1:{common}] AS cs FROM v GROUP BY lang),
 ref AS (SELECT s.lang, [{means}] AS classes, coalesce(b.xs, []) AS xs, list_transform(coalesce(b.cs, []), lambda y: y / s.words) AS share FROM s LEFT JOIN top b ON s.lang IS NOT DISTINCT FROM b.lang),
 grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
 often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
 cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM often) GROUP BY doc_id),
 lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM w),
 met AS (SELECT c.*, o.classes, coalesce(o.xs, []) AS xs, coalesce(o.share, []) AS share, list_transform(c.w, lambda x: lower(x)) AS low, coalesce(k.n, 0) AS repeats, len(li.l) - len(list_distinct(li.l)) AS dups
  FROM c JOIN lines li ON li.doc_id = c.doc_id LEFT JOIN cover k ON k.doc_id = c.doc_id LEFT JOIN ref o ON o.lang IS NOT DISTINCT FROM c.lang),
 hit AS (SELECT *, list_transform(xs, lambda x: len(list_filter(low, lambda y: y = x)) / greatest(1, words)) AS hits, [{", ".join(f"{k} / greatest(1, chars)::DOUBLE" for k in SHARES)}] AS own, words < 10 OR 100 * repeats > 20 * words AS failed FROM met)
 SELECT doc_id, words::BIGINT AS n_words, chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, repeats::BIGINT AS n_repeat_words, failed AS base_failed,
 NOT failed AND NOT coalesce(chars >= {LEAST_CHARS} AND {js("own", "classes")} > {CHAR_LIMIT}, FALSE) AND NOT coalesce(words >= {LEAST_WORDS} AND {js(rest("hits"), rest("share"))} > {WORD_LIMIT}, FALSE) AS kept FROM hit"""


def _crc(text: str) -> str:
    """crc32 of a string's UTF-8 bytes: half a byte at a time, low half first."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    halves = f"list_transform(range(length(hex(encode({text})))), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), xor(i, 1) + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce({halves}, lambda c, x: xor(c >> 4, ({steps}::BIGINT[])[xor(c, x) % 16 + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def resample(seed: int = 7, percent: int = 25, least_words: int = 20, buckets: int = 10_000) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH w AS (SELECT TRUE AS own, doc_id, {words} AS w FROM documents UNION ALL SELECT FALSE, item_id, {words} FROM benchmark),
 f AS (SELECT own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
 b AS (SELECT f, {_crc("f")} % {buckets} AS b FROM (SELECT DISTINCT f FROM f)),
 c AS (SELECT b, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM f JOIN b USING (f) GROUP BY b),
 z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c),
 g AS (SELECT b, floor(1000 * ln((c.t + 1) * (z.s + {buckets}) / ((c.s + 1) * (z.t + {buckets}))))::BIGINT AS gain FROM c, z),
 d AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE own GROUP BY doc_id),
 h AS (SELECT doc_id, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM documents),
 e AS (SELECT h.doc_id, coalesce(d.n, 0) AS n_features, coalesce(d.weight, 0) AS weight, coalesce(d.weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM h LEFT JOIN d ON d.doc_id = h.doc_id),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM e WHERE n_features >= {2 * least_words - 1})
 SELECT e.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= {percent} * n // 100 THEN r END AS rank FROM e LEFT JOIN r ON r.doc_id = e.doc_id"""


def trie() -> str:
    return rf"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT c, c - c % 20 AS base, {_crc("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
 m AS (SELECT k.*, (SELECT count(*) FROM o WHERE o.c = k.base AND o.p <= k.h) AS got FROM k),
 t AS (SELECT m.c, o.p, role, text FROM m JOIN o ON o.c = m.base AND o.p <= m.h UNION ALL SELECT m.c, o.p - m.h + m.got, role, text FROM m JOIN o ON o.c = m.c AND o.p > m.h),
 s AS (SELECT c, p, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY p) AS path FROM t),
 x AS (SELECT c, p, words, path FROM s UNION ALL SELECT c, 0, 0, '' FROM k),
 q AS (SELECT c, p, words, path, max(p) OVER (PARTITION BY c) AS size FROM x),
 node AS (SELECT path, p AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE p = size), '')) AS ends_sha256 FROM q GROUP BY path, p),
 edge AS (SELECT *, CASE WHEN depth > 0 THEN left(path, 32 * (depth::INT - 1)) END AS up FROM node),
 kids AS (SELECT up, count(*) AS n FROM edge WHERE up IS NOT NULL GROUP BY up),
 below AS (SELECT a.path, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (WHERE b.path NOT IN (SELECT up FROM kids)) AS leaves FROM edge b JOIN q ON q.c = b.conv_id AND q.p <= b.depth JOIN node a ON a.path = q.path GROUP BY a.path)
 SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
 FROM edge n JOIN below b ON b.path = n.path LEFT JOIN kids ON kids.up = n.path LEFT JOIN node u ON u.path = n.up"""


ORACLES = {"op4_quality": quality(), "op9_secrets": secrets(), "op10_jaccard": jaccard(), "op12_resample": resample(), "op13_trie": trie()}
