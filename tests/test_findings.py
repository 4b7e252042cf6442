"""Rows on which queries once differed from their SQL, or grew out of proportion."""

import duckdb
import pytest

from prosemill import catalog
from prosemill.functions import text as T
from prosemill.plans import structure
from prosemill.plans.shared import rounded


@pytest.fixture
def written(spark, tmp_path):
    """Writes a table as parquet for both engines; gives the folder and a function of a query's name that returns both engines' rows."""

    def run(name: str, **tables: str):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        rel = con.sql(catalog.ORACLES[name])
        order = [rel.columns.index(c) for c in df.columns]
        return sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)

    return run


def test_negations_end_where_letters_of_other_scripts_begin(written):
    got, want = written("entity_diffs", conversations="SELECT 1 AS conv_id, unnest(range(2)) AS turn, 'user' AS role, unnest(['es noñcodota', 'ñno queda']) AS text UNION ALL SELECT 2, unnest(range(2)), 'user', unnest(['yes', 'éno es'])")
    assert got == want and len(got) == 4


def test_only_whole_references_are_decoded_and_once():
    assert T.html_text("a &amp;&amp</p>b &amp;lt; &#39;&am") == "a &&amp\nb &lt; '&am"


def test_windows_take_no_fold_over_paragraphs(spark):
    """A fold that appends to an array copies the square of a text's paragraphs."""
    docs = spark.createDataFrame([(1, "ab\n\n" * 5_000), (2, None), (3, "x" * 700)], "doc_id long, text string")
    for rows in (structure.chosen_windows(docs, 500, 3), structure.sampled(docs, 3, 300, 900, "7")):
        assert "aggregate(" not in rows._jdf.queryExecution().analyzed().toString()
    got = [tuple(r) for r in structure.chosen_windows(docs, 500, 3).select("doc_id", "window", "start", "stop").orderBy("doc_id", "window").collect()]
    assert got == [(1, 0, 0, 500), (1, 1, 9748, 10248), (1, 2, 19496, 19996), (2, 0, 0, 0), (3, 0, 0, 500)]


def test_windows_are_scored_once_for_both_passes(spark, sf, monkeypatch):
    calls, coded = [], structure.scoring.coded
    monkeypatch.setattr(structure.scoring, "coded", lambda *a, **k: calls.append(a) or coded(*a, **k))
    structure._timeline(spark, sf)
    assert len(calls) == 1


#: Odd texts: blank, missing, short, of equal tokens, with runs of white space, of other scripts, longer.
ODD = """SELECT i AS doc_id, CASE i % 3 WHEN 0 THEN 'en' ELSE 'fr' END AS lang, 'src' || i % 2 AS source, t AS text, length(t) AS n_chars FROM (SELECT unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT ['', NULL, 'one', ' ', 'a b', 'aaa aaa aaa aaa aaa aaa aaa', ' a a a a a a a a',
 'The sea was calm. The boat was small! Was it? No.' || chr(10) || ' ' || chr(10) || 'The end, said 3 men' || chr(10) || '... and the sea was calm again.', 'Été à la mer, ñandú İstanbul. Été à la mer? 12 345!' || chr(10) || chr(10) || 'Fin', repeat('the cat sat on the mat. ', 30) || repeat(chr(10) || 'So it was', 9)] AS l))"""


@pytest.mark.parametrize("name", ["cadence_metrics", "model_compare", "doc_delta_histogram", "texture_score"])
def test_tokens_are_scored_by_chunks(spark, sf, written, name):
    """A row for each token was joined and sorted; now a chunk's distinct tokens are."""
    got, want = written(name, documents=ODD)
    assert len(got) == len(want) > 1
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
    assert "posexplode" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()


def test_repeats_are_counted_within_a_row(spark, sf, written):
    got, want = written("repeat_rates", documents=ODD)
    assert got == want and len(got) == 5
    assert "Exchange" not in catalog.QUERIES["repeat_rates"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["spike_patterns", "spike_stats", "spike_sentences", "spike_highlights", "line_surprise", "doc_signature"])
def test_spikes_are_found_by_chunks(spark, sf, written, name):
    got, want = written(name, documents=ODD)
    assert len(got) == len(want) > 1
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
    assert "posexplode" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()


def test_neighbouring_sentences_meet_within_a_row(spark, sf, written):
    got, want = written("adjacent_jaccard", documents=ODD)
    assert got == want and len(got) == 3
    assert "Exchange" not in catalog.QUERIES["adjacent_jaccard"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_window_that_equals_its_limit_is_on_the_side_of_the_sql(spark, sf, written):
    """Its variance is 14/9, a sixteenth of the text's; by rounding, DuckDB has it beyond the limit."""
    counts = [15, 13, 6, 3, 2, 1, 3, 5, 8, 10, 11, 2, 12, 17, 6, 12, 6, 0]
    got, want = written("dead_zones", documents=f"SELECT 1 AS doc_id, 'en' AS lang, 's' AS source, '{' '.join('a ' * n + '1.' for n in counts)}' AS text UNION ALL SELECT * REPLACE (doc_id + 2 AS doc_id) FROM (SELECT doc_id, lang, source, text FROM ({ODD}))")
    assert got == want and (1, 2, 3, 6, 2) in got and len(got) > 2
    assert "Exchange" not in catalog.QUERIES["dead_zones"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_no_rows(spark, monkeypatch):
    """Each pair of a chunk was a row that was joined and sorted; now a bucket's pairs are one. Contexts that crowd a bucket are dealt over all."""
    scoring = structure.scoring
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j * j + j) % 23}" for j in range(300)) + ".\n\nThe end, it was.", "prose") for i in range(6)], "doc_id long, text string, doc_type string").repartition(3)
    rows, facts, distinct, _, buckets, hot = scoring.scored(docs, structure.kept)
    assert buckets == 1 and not len(hot) and facts.count() == scoring.chunk_tokens(rows).count() + rows.where("pairs is not null").count() and distinct == len({w for r in docs.collect() for w in scoring._TOKEN.findall(r.text)})
    near = lambda df: [[None if x is None else round(x, 7) if isinstance(x, float) else x for x in r] for r in sorted(map(tuple, df.collect()), key=repr)]
    whole = near(scoring.analyse(docs, structure.kept)), near(scoring.segments(docs, structure.kept))
    monkeypatch.setattr(scoring, "BUCKET", 40)
    monkeypatch.setattr(scoring, "HOT", 40)
    *_, buckets, hot = scoring.scored(docs, structure.kept)
    assert buckets > 3 and 0 < len(hot) < distinct
    assert (near(scoring.analyse(docs, structure.kept)), near(scoring.segments(docs, structure.kept))) == whole


def test_halves_are_rounded_as_by_the_sql(spark):
    """Spark's own rounding takes the shortest decimals of a double, DuckDB's the product with a million."""
    values = [(1_000_000 + 7919 * i + 0.5) / 1e6 for i in range(2000)] + [1.6168275, 4.1408355, -2.0000005, 0.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(rounded("x")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]


def test_pairs_of_groups_are_counted_by_stretches(spark, sf, written):
    """Each token was a row, and pairs were joined as strings."""
    got, want = written("author_divergence", documents=ODD)
    assert len(got) == len(want) == 2
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
    plan = catalog.QUERIES["author_divergence"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "explode" not in plan and "Join" not in plan


#: Documents with flat stretches that repeat or drone, in ASCII and with letters, marks and white space beyond it.
FLAT = f"""SELECT 100 + i AS doc_id, 'en' AS lang, 's' AS source, repeat(t, 3) || chr(10) AS text, 0 AS n_chars FROM (SELECT unnest(range(4)) AS i, unnest([{", ".join("'" + " ".join(f"{x} {w} it was {y}." for w in "one two three four five six".split()) + " '" for x, y in (("The cat cat", "seen"), ("Nationality été perhaps", "eñdowed"), ("Sea", "likely" + chr(0x212A)), ("It’s a" + chr(0x0B) + "b", "being  well written")))}]) AS t) UNION ALL SELECT * FROM ({ODD})"""


def test_dead_zones_are_judged_within_a_document(spark, sf, written):
    """Each judgement of a stretch ran its expressions several times, the merged ones the whole query twice."""
    got, want = written("dead_zone_report", documents=FLAT)
    assert got == want and len({r[0] for r in got}) >= 4
    plan = catalog.QUERIES["dead_zone_report"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan and plan.count("Join") == 2  # of tokens with their counts, of sentences with their text


def test_no_sentences_have_no_dead_zones(spark):
    seg = spark.createDataFrame([], "doc_id long, level string, number int, start_char int, end_char int, mean_surprisal double, tokens int")
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert structure.dead_zones(seg, docs).collect() == []


def test_a_chunk_keeps_less_than_its_text(spark):
    """Each text kept numbers of its pairs, and each chunk the list of those, which follow from its tokens."""
    scoring = structure.scoring
    text = ". ".join(" ".join(f"wort{i * i * j % 2003}" for i in range(j, j + 9)) for j in range(1, 1500))
    docs = spark.createDataFrame([(1, text, "prose")], "doc_id long, text string, doc_type string")
    rows, *_ = scoring.scored(docs, structure.kept)
    assert sum(sum(map(len, filter(None, c.to_pylist()))) for c in rows.toArrow().columns if str(c.type).endswith("binary")) < 0.9 * len(text)


@pytest.mark.parametrize("name", ["window_sentences", "window_cadence", "cadence_timeline"])
def test_windows_are_measured_where_their_chunk_is(spark, sf, written, monkeypatch, name):
    """Segments or windows with facts were written beside the chunks and joined to them."""
    writes, kept = [], structure.kept
    monkeypatch.setattr(structure, "kept", lambda df, what: writes.append(what) or kept(df, what))
    got, want = written(name, documents=f"SELECT * FROM ({ODD}) WHERE text IS NOT NULL")
    assert writes == ["coded", "tokens"] and len(got) == len(want) > 4
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)
