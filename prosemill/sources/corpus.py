"""Readers: tolerant JSON lines, folders of texts, manifests, feeds and e-books; and a writer of splits. All by paths that Spark can read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {"toc", "nav", "cover", "titlepage", "copyright", "colophon", "imprint", "halftitle", "dedication", "uncopyright"}


def json_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON lines with their file; lines that aren't objects are skipped, as are missing files."""
    rows = spark.read.option("ignoreMissingFiles", "true").text(paths).where(F.trim("value").startswith("{"))
    parsed = rows.select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.col("_metadata.file_path").alias("file"))
    return parsed.where("r._corrupt is null").select("r.*", "file").drop("_corrupt")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, author (the folder, as words), title (the file's name, as words) and text of all .txt files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    words = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return rows.select("path", words(F.element_at(F.split("path", "/"), -2)).alias("author"), words(F.regexp_extract("path", r"([^/]+)\.txt$", 1)).alias("title"), "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: .json, .jsonl, .csv, .tsv or .parquet; any other is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, sep="," if kind == "csv" else "\t", header=True)
    if kind in ("json", "jsonl"):
        return spark.read.json(path, multiLine=kind == "json")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{kind}")


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def feed_entries(xml: str | None, most: int = 2_000_000) -> list[tuple[str, str, str, str]]:
    """title, link, content and date of a feed's entries; none if it is too long, declares entities or can't be parsed."""
    if not xml or len(xml) > most or "<!ENTITY" in xml:
        return []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out = []
    for e in root.iter():
        if _plain(e.tag) not in ("item", "entry"):
            continue
        of: dict[str, str] = {}
        for c in e:
            name = _plain(c.tag)
            if name == "link" and c.get("href") and c.get("rel", "alternate") == "alternate":
                of["link"] = c.get("href", "")
            elif (c.text or "").strip():
                of.setdefault(name, (c.text or "").strip())
        pick = lambda *names: next((of[n] for n in names if n in of), "")  # noqa: E731,B023
        out.append((pick("title"), pick("link", "guid"), pick("encoded", "content", "description", "summary"), pick("published", "pubDate", "updated")))
    return out


def feeds(df: DataFrame, column: str) -> DataFrame:
    """An entry per row: title, url, content, date."""
    kind = "array<struct<title:string,url:string,content:string,date:string>>"

    @F.pandas_udf(kind)
    def parse(xml: pd.Series) -> pd.Series:
        return xml.map(lambda x: [dict(zip(("title", "url", "content", "date"), e, strict=True)) for e in feed_entries(x)])

    return df.select(F.explode(parse(column)).alias("e")).select("e.*")


def book_text(data: bytes) -> str:
    """Text of an e-book in the order of its spine, without front matter; of its pages by name if it has no spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        opf = next((n for n in names if n.endswith(".opf")), None)
        pages: list[str] = []
        if opf:
            root = ElementTree.fromstring(z.read(opf))
            item = {e.get("id"): e.get("href") for e in root.iter() if _plain(e.tag) == "item" and "html" in (e.get("media-type") or "")}
            base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
            pages = [base + item[e.get("idref")] for e in root.iter() if _plain(e.tag) == "itemref" and e.get("idref") in item]
        pages = [p for p in pages or sorted(n for n in names if re.search(r"\.x?html?$", n)) if p in names and re.sub(r"\.x?html?$", "", p.rsplit("/", 1)[-1]) not in SKIPPED]
        return "\n\n".join(t for p in pages if (t := " ".join(re.sub(r"<[^>]+>", " ", re.sub(r"(?s)<head.*?</head>", " ", z.read(p).decode("utf-8", "replace"))).split())))


def books(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all e-books below a folder; a file that can't be read has a null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for data in pdf["content"]:
                try:
                    out.append(book_text(data))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def write_splits(df: DataFrame, path: str, split: str = "split", source: str = "source") -> DataFrame:
    """Parquet by split, and a manifest of rows by source and split."""
    df.write.partitionBy(split).mode("overwrite").parquet(f"{path}/rows")
    counts = df.groupBy(source, split).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").json(f"{path}/manifest")
    return counts
