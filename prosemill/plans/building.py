"""Corpus building: names, staged unions with accounts, rows through files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, parsing
from ..operators import matching
from ..sources import formats
from .shared import shared_dir, table

_WANT = {
    "spark": "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('The ', p_name, ' Co') WHEN 2 THEN concat('mini ', substring_index(p_name, ' ', -1)) WHEN 3 THEN substring(p_name, 2, length(p_name) - 3) ELSE concat('no such ', p_brand) END",
    "duck": "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('The ', p_name, ' Co') WHEN 2 THEN concat('mini ', string_split(p_name, ' ')[-1]) WHEN 3 THEN substr(p_name, 2, length(p_name) - 3) ELSE concat('no such ', p_brand) END",
}


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the parts' names (other case, longer, shorter, last word alone) found among the names in order of first use."""
    part = table(spark, sf_dir, "part")
    wants = part.select("p_partkey", F.expr(_WANT["spark"]).alias("want"))
    return matching.match_names(wants, part, "want", "p_name", "p_partkey").select("p_partkey", "want", F.col("step").cast("long").alias("step"), "found")


def _sample_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 12)


STAGES = ["skipped_short", "skipped_long", "skipped_duplicate_id", "skipped_duplicate_text", "skipped_duplicate_opening"]


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark passages in one corpus: too short and too long ones go, then repeated ids, repeated texts (letter case and blanks aside) and repeated openings within a group; the first stays."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("seq"), F.col("source"), "text")
    bench = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2 + 1).alias("seq"), F.lit("benchmark").alias("source"), "text")
    folded = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))
    rows = docs.unionByName(bench).withColumns({"sample_id": _sample_id(F.col("source"), F.col("text")), "key": F.sha1(folded), "opening": F.sha1(F.concat_ws("\0", F.col("source"), F.substring(folded, 1, 80)))})
    stages = [
        (STAGES[0], "drop", F.length("text") < 120), (STAGES[1], "drop", F.length("text") > 12_000), (STAGES[2], "first", F.col("sample_id")), (STAGES[3], "first", F.col("key")), (STAGES[4], "first", F.col("opening")),
    ]
    return matching.staged(rows, "seq", stages)


def originals_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return originals(spark, sf_dir).where("skipped IS NULL").select("seq", "sample_id", "source")


def originals_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.accounts(originals(spark, sf_dir), STAGES).select("stage", F.col("place").cast("long"), "seen", "skipped")


def jsonl_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, written as gzipped JSON lines to the shared folder and read again by file."""
    formats.register(spark)
    path = f"{shared_dir(spark)}/turns-{os.urandom(8).hex()}"
    path = path if "://" in path else f"file://{path}"
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.format("prosemill-jsonl").option("compression", "gzip").mode("append").save(path)
    return spark.read.format("prosemill-jsonl").schema("conv_id long, turn long, role string, text string").load(path)


def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON objects of events found within sentences and code fences around them."""
    e = table(spark, sf_dir, "events")
    around = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here {it} is: "), "props", F.lit(" as {asked}."))).otherwise(F.concat(F.lit("Sure.\n```json\n"), "props", F.lit("\n```\n{}")))
    return e.select("event_id", parsing.json_objects(around).alias("found")).select("event_id", F.get_json_object("found", "$.k").cast("long").alias("k"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates, spelled as in mails or by ISO, as seconds since 1970."""
    o = table(spark, sf_dir, "orders")
    spelled = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0130"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", dates.unix_times(spelled).alias("unix"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author and language from book headers in front of the documents."""
    docs = table(spark, sf_dir, "documents")
    book = F.concat(F.lit("Title: Book "), F.col("doc_id").cast("string"), F.lit("\n   of "), "source", F.lit("\n\nAuthor: "), "source", F.lit("  Writer\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Language: "), "lang", F.lit("\n"))).otherwise(""), F.lit("\n"), "text")
    return docs.select("doc_id", *[parsing.header_field(book, n).alias(n.lower()) for n in ("Title", "Author", "Language")])


_ORIGINALS = r"""r0 AS (SELECT doc_id * 2 AS seq, source, text FROM documents UNION ALL SELECT item_id * 2 + 1, 'benchmark', text FROM benchmark),
 r1 AS (SELECT seq, source, text, substr(sha1(source || chr(0) || text), 1, 12) AS sample_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ',
   'g')) AS folded FROM r0),
 r2 AS (SELECT *, CASE WHEN length(text) < 120 THEN 0 WHEN length(text) > 12000 THEN 1 END AS out FROM r1),
 r3 AS (SELECT *, coalesce(out, CASE WHEN row_number() OVER (PARTITION BY out, sample_id ORDER BY seq) > 1 THEN 2 END) AS out3 FROM r2),
 r4 AS (SELECT *, coalesce(out3, CASE WHEN row_number() OVER (PARTITION BY out3, folded ORDER BY seq) > 1 THEN 3 END) AS out4 FROM r3),
 r5 AS (SELECT *, coalesce(out4, CASE WHEN row_number() OVER (PARTITION BY out4, source, substr(folded, 1, 80) ORDER BY seq) > 1 THEN 4 END) AS out5 FROM r4)"""
QUERIES = {f.__name__: f for f in (name_match, originals_build, originals_accounts, jsonl_turns, json_from_text, date_forms, header_fields)}
ORACLES = {
    "name_match": f"""WITH n AS (SELECT p_name AS name, lower(p_name) AS l, min(p_partkey) AS o FROM part GROUP BY p_name), w AS (SELECT p_partkey, {_WANT["duck"]} AS want FROM part),
 d AS (SELECT DISTINCT want, lower(trim(want)) AS s FROM w), m AS (SELECT want, name, o, CASE WHEN s = l THEN 1 WHEN contains(s, l) OR contains(l,
   s) THEN 2 WHEN list_contains(string_split(l, ' '), string_split(s, ' ')[-1]) THEN 3 END AS step FROM d, n),
 b AS (SELECT want, step, name FROM (SELECT *, row_number() OVER (PARTITION BY want ORDER BY step, o) AS k FROM m WHERE step IS NOT NULL) WHERE k = 1)
 SELECT w.p_partkey, w.want, b.step::BIGINT AS step, b.name AS found FROM w LEFT JOIN b ON b.want = w.want""",
    "originals_build": f"WITH {_ORIGINALS} SELECT seq, sample_id, source FROM r5 WHERE out5 IS NULL",
    "originals_accounts": f"WITH {_ORIGINALS} SELECT s.stage, s.place::BIGINT AS place, count(*) FILTER (WHERE coalesce(out5, 5) >= place) AS seen, count(*) FILTER (WHERE out5 = place) AS skipped FROM r5, (SELECT unnest({[*STAGES, 'kept']}) AS stage, unnest(range({len(STAGES) + 1})) AS place) s GROUP BY s.stage, s.place",
    "jsonl_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "json_from_text": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "date_forms": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT - CASE WHEN o_orderkey % 2 = 0 THEN 5400 ELSE 0 END AS unix FROM orders",
    "header_fields": "SELECT doc_id, 'Book ' || doc_id || ' of ' || source AS title, source || ' Writer' AS author, CASE WHEN doc_id % 2 = 0 THEN lang END AS language FROM documents",
}
