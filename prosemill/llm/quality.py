"""Quality rules: how far a text's characters and common words lie from those of its language.

Two passes, with built-in functions alone. The first gathers a reference per language: the mean histogram of character classes over all its texts of
10 words or more that aren't mostly capitals or strewn with symbols, and its `common` most frequent short words with their shares. The second compares each text's two
histograms with its language's by the Jensen-Shannon distance (base 2, 0 to 1); a distance counts only from a least length on, where histograms are stable.

Defined cases: a null or blank text has no words and fails the base rule; a null language is a language of its own; a language without
any text fit for a reference has distances to none and is judged by the base rule alone; ties among common words go to the
smaller word; repeated rows get equal verdicts; other columns pass through, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, fresh, materialise

#: Character classes, counted without white space; lower-case letters are the remainder, letters of neither case are `other`.
KINDS = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": r"[#*$%&|<>]", "bang": "!", "stop": r"[.,;:?'\"()-]", "other": r"[^\p{Ll}\p{Lu}\p{Nd}#*$%&|<>!.,;:?'\"()\-\x20\x09-\x0D]"}
SHARES = ["lower", *KINDS]
#: Distances above which a text is rejected, and the lengths from which they count.
CHAR_LIMIT, WORD_LIMIT, LEAST_CHARS, LEAST_WORDS = 0.17, 0.3, 100, 60
SHORT = 5
#: Languages up to which their references are broadcast; a reference has 12 words and 19 numbers.
BROADCAST_LANGS = 20_000


def _words(text: Column) -> Column:
    """The words of a text."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _counted(df: DataFrame, text: str) -> DataFrame:
    """df with the words and counts of its text in columns named _q_*."""
    t = F.coalesce(F.col(text), F.lit(""))
    # most characters are a-z and blanks, of no counted class: without them the classes are counted over a tenth of the text
    df = df.withColumns({"_q_words": _words(t), "_q_few": F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", "")})
    counts = {f"_q_{k}": F.regexp_count("_q_few", F.lit(p)).cast("long") for k, p in KINDS.items()}
    df = df.withColumns({"_q_n": F.size("_q_words").cast("long"), "_q_chars": F.length(F.array_join("_q_words", "")).cast("long"), **counts})
    return df.withColumn("_q_lower", F.col("_q_chars") - sum((F.col(f"_q_{k}") for k in KINDS), F.lit(0)))


def reference(df: DataFrame, text: str, lang: str, common: int) -> DataFrame:
    """A row per language: mean class shares, common words and their shares."""
    rows = _counted(df.select(F.col(lang).alias("_l"), F.col(text).alias("_t")), "_t")
    plain = F.expr("_q_n >= 10 and 100 * _q_symbol <= _q_chars and 100 * _q_bang <= 3 * _q_chars and 10 * _q_upper <= 3 * _q_chars")
    # one pass: a text's short words, and an empty word that carries its shares
    each = rows.select("_l", F.when(plain, F.concat(F.array(F.lit("")), "_q_words")).alias("ws"), F.when(plain, F.array(F.lit(1.0), F.col("_q_n").cast("double"), *[F.col(f"_q_{k}") / F.col("_q_chars") for k in SHARES])).alias("s"))
    # outer: no filter over the words' expressions is inferred and pushed to the scan
    each = each.select("_l", "s", F.explode_outer("ws").alias("w")).where(F.length("w") <= SHORT)
    held = lambda i: F.sum(F.when(F.col("w") == "", F.get("s", F.lit(i))))
    sums = each.groupBy("_l", "w").agg(F.count("*").alias("c"), *[held(i).alias(c) for i, c in enumerate(["n", "words", *SHARES])])
    sums = materialise(sums, "quality-sums")
    shares = sums.where("w = ''").select(F.col("_l").alias("lang"), "n", "words", *SHARES)
    found = sums.where("w <> ''").groupBy("_l", F.lower("w").alias("w")).agg(F.sum("c").alias("c")).where(F.col("w").rlike(r"^\p{L}+$"))
    # the most frequent of each language, first within parts of its words: no task sees a language's whole vocabulary
    order = W.partitionBy("_l", "s").orderBy(F.desc("c"), "w")
    found = found.withColumn("s", F.pmod(F.xxhash64("w"), F.lit(256))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    found = found.groupBy("_l").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "w"))), 1, common).alias("ws"))  # 256 * common words a language
    ws = F.coalesce("ws", F.array().cast("array<struct<c:bigint,w:string>>"))
    return shares.join(found, F.col("lang").eqNullSafe(F.col("_l")), "left").select(
        "lang", F.array(*[F.round(F.col(k) / F.col("n"), 9) for k in SHARES]).alias("classes"),
        F.transform(ws, lambda x: x["w"]).alias("common"), F.transform(ws, lambda x: -x["c"] / F.col("words")).alias("shares"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) / 2 + part(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def _repeats(df: DataFrame) -> DataFrame:
    """_q_repeats: words in 5-word windows that stand twice or more in the text. Windows by 64-bit hash; sorted only where some repeat."""
    df = df.withColumn("_q_hash", F.transform("_q_words", lambda w: F.xxhash64(w)))
    five = lambda x, i: F.xxhash64(x, *[F.get("_q_hash", i + k) for k in range(1, 5)])
    df = df.withColumn("_q_win", F.when(F.col("_q_n") >= 5, F.slice(F.transform("_q_hash", five), 1, (F.col("_q_n") - 4).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    at = F.sort_array(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.size(F.array_distinct("_q_win")) < F.size("_q_win"), at).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda e, i: F.coalesce(F.get("_q_sorted", i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("_q_sorted", i + 1)["h"] == e["h"], F.lit(False))
    df = df.withColumn("_q_where", F.sort_array(F.transform(F.filter("_q_sorted", same), lambda e: e["i"])))
    steps = F.transform("_q_where", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_q_where", i + 1) - p, F.lit(5))).cast("long"))
    return df.withColumn("_q_repeats", F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x))


def assess(df: DataFrame, text: str = "text", lang: str = "lang", common: int = 12, out_col: str = "quality") -> DataFrame:
    """df with out_col (in place of any such column) struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept>."""
    names = df.columns
    text, lang = f"c{names.index(text)}", f"c{names.index(lang)}"
    df = df.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column of df clashes with the helpers
    ref = materialise(reference(df, text, lang, common), "quality-reference")
    ref = ref.select(F.col("lang").alias("_q_rl"), F.struct("classes", "common", "shares").alias("_q_ref"))
    ref = F.broadcast(ref) if ref.count() <= BROADCAST_LANGS else ref
    out = _repeats(_counted(df, text))
    out = out.join(ref, out[lang].eqNullSafe(F.col("_q_rl")), "left")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = out.withColumn("_q_lines", lines).withColumn("_q_common", F.coalesce(F.array_join("_q_ref.common", ","), F.lit("")))
    # places of the text's words among the common ones, without the words that aren't
    at = F.array_remove(F.transform(_words(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: F.find_in_set(w, F.col("_q_common"))), 0)
    out = out.withColumn("_q_at", at)
    out = out.withColumn("_q_hits", F.transform(F.coalesce("_q_ref.common", F.array().cast("array<string>")), lambda w, i: (F.size("_q_at") - F.size(F.array_remove("_q_at", i + 1))) / F.greatest(F.lit(1), F.col("_q_n"))))
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
    out = out.withColumns(
        {
            "_q_cd": F.when(F.col("_q_chars") >= LEAST_CHARS, distance(F.array(*[F.col(f"_q_{k}") / F.col("_q_chars") for k in SHARES]), F.col("_q_ref.classes"))),
            "_q_wd": F.when(F.col("_q_n") >= LEAST_WORDS, distance(rest(F.col("_q_hits")), rest(F.coalesce("_q_ref.shares", F.array().cast("array<double>"))))),
            "_q_failed": (F.col("_q_n") < 10) | (100 * F.col("_q_repeats") > 20 * F.col("_q_n")),
            "_q_dup": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        }
    )
    kept = ~F.col("_q_failed") & ~F.coalesce(F.col("_q_cd") > CHAR_LIMIT, F.lit(False)) & ~F.coalesce(F.col("_q_wd") > WORD_LIMIT, F.lit(False))
    found = F.struct(
        F.col("_q_n").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbol").alias("n_symbols"), F.col("_q_dup").alias("n_dup_lines"), F.col("_q_repeats").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"), F.col("_q_cd").alias("char_distance"), F.col("_q_wd").alias("word_distance"), kept.alias("kept"),
    )
    kept_cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != out_col]
    return out.select(*kept_cols, found.alias(out_col))


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep. The row number is there to hold the filter back: pushed below the projections it would spell out all their expressions, each many times."""
    quality, row = fresh(df, "quality"), fresh(df, "row")
    rows = assess(df, text, lang, out_col=quality).withColumn(row, F.monotonically_increasing_id())
    return rows.where(F.col(f"{quality}.kept") & (F.col(row) >= 0)).drop(quality, row)
