"""Measures of a text's surface as columns (two small Arrow UDFs count words; the rest is built in): characters, words, syllables, sentences, lines, and rates of phrases. All words and lines of a text count."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Words, sentences, ends of sentences and paragraphs as patterns; symbols and punctuation marks; kinds of lines.
WORD, SENTENCE, AFTER_SENTENCE, BREAK = r"[A-Za-z]+(?:'[A-Za-z]+)?", r"[^.!?\n]+[.!?]?\s*", r"(?<=[.!?])\s+", r"\n\s*\n+"
SYMBOLS, MARKS = r"[{}\[\]();<>/\\=+\-*#@]", r"[,.;:!?…—–\-()\[\]{}\"'“”‘’]"
CODE = r"(?i)^\s*(?:def |class |from |import |package |#include|using |public |private |func |let |var )"
LINES = {"list": r"^\s*(?:[-*+]|•|\d+[.)])\s+\S", "heading": r"^\s*#{1,6}\s+\S", "quote": r"^\s*>\s+\S", "indented": r"^(?:\t+|\s{4,})\S"}
#: Function words and discourse markers.
FUNCTION_WORDS = (
    "a an the and or but nor for yet so if then else when while as since until before after although because though unless whereas in on at by to from with of into through during upon about between among is am are was were be been being have has had do does did will would shall should can could may might must "
    "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs this that these those who whom whose which what not no very much many more most some any all each every both few several here there where how just also too only even still already again"
).split()
MARKERS = (
    "however therefore moreover furthermore nevertheless nonetheless meanwhile consequently accordingly thus hence indeed actually basically essentially specifically particularly notably importantly significantly alternatively conversely similarly likewise regardless otherwise finally ultimately"
).split()
#: Worn phrases, and hedging ones; each counts wherever it stands, in either case.
WORN = """it's important to note|it's worth noting|it is important to note|it is worth noting|it should be noted|it bears mentioning|in today's world|in this day and age|at the end of the day|when it comes to|on the other hand|in other words|needless to say|it goes without saying|dive into|dive deep|diving into|deep dive|delve into|delving into|the landscape of|the realm of|the world of|leverage|leveraging|leveraged|tapestry|tapestries|multifaceted|nuanced|paradigm|paradigm shift|in conclusion|to summarize|to sum up|let's explore|let us explore|we'll explore|it's crucial|it is crucial|it's essential|it is essential|plays a crucial role|plays a vital role|plays a key role|a testament to|stands as a testament|the importance of|the significance of|it's fascinating|it is fascinating|a myriad of|a plethora of|navigate the|navigating the|foster|fostering|fostered|unlock|unlocking|unlocked|empower|empowering|empowered|in the realm of|in the landscape of|resonate with|resonates with|resonating with|holistic|holistic approach|ever-evolving|ever-changing|ever-growing|robust|cutting-edge|game-changer|transformative|groundbreaking""".split("|")
HEDGING = """to some extent|to a certain extent|to a degree|it could be argued|one could argue|one might argue|generally speaking|broadly speaking|loosely speaking|in many ways|in some ways|in a sense|more or less|arguably|presumably|supposedly|it seems|it appears|it would seem|perhaps|possibly|potentially|tends to|tend to|tended to|in some cases|in certain cases|in many cases|somewhat|relatively|fairly|rather|to varying degrees|a certain degree of""".split("|")

METRICS = [
    "chars_count", "alpha_char_fraction", "digit_char_fraction", "symbol_char_fraction", "whitespace_char_fraction", "punct_charset_size", "punct_variety_per_1000_chars", "word_count", "word_unique", "word_ttr", "word_hapax_ratio", "word_top5_frac",
    "adjacent_word_repeat_rate", "bigram_repeat_rate", "trigram_repeat_rate", "word_len_mean", "word_len_p90", "word_len_cv", "syllables_per_word_mean", "syllables_per_word_p90", "syllables_per_word_cv", "sent_words_mean", "sent_words_p90", "sent_words_cv",
    "line_code_fraction", "line_list_fraction", "line_heading_fraction", "line_quote_fraction", "line_indented_fraction",
]
TAXONOMY = [
    "comma_per_100w", "semicolon_per_100w", "dash_per_100w", "colon_per_100w", "question_rate", "exclamation_rate", "one_sent_para_rate", "function_word_rate", "discourse_marker_rate", "parenthetical_rate", "slop_phrase_density", "hedging_phrase_rate", "sentence_opener_entropy", "paragraph_metric_cv",
]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a))


def variation(a: Column) -> Column:
    """Deviation over mean of two values or more, not all 0."""
    m = mean(a)
    squares = _sum(F.transform(a, lambda x: x * x)) / F.size(a)
    return F.when((F.size(a) >= 2) & (F.abs(m) > 1e-12), F.sqrt(F.greatest(F.lit(0.0), squares - m * m)) / F.abs(m))


def quantile(s: Column, q: float) -> Column:
    """Of a sorted array, interpolated between the two nearest values."""
    a, at = s, (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.when(F.size(a) > 0, F.get(s, low) + (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low)) * (at - low))


@lru_cache(maxsize=1 << 17)
def syllables(word: str) -> int:
    """Groups of vowels, one at least; a final e counts only after l or y."""
    w = re.sub("[^a-z]", "", word)
    groups = len(re.findall("[aeiouy]+", w))
    return max(1, groups - (groups > 1 and w.endswith("e") and not w.endswith(("le", "ye"))))


_COUNTS = ["unique", "once", "five", "repeats", "pairs", "triples"] + [f"{x}_{y}" for x in ("len", "syl") for y in ("mean", "p90", "cv")]


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in _COUNTS]))
def word_counts(words: pd.Series) -> pd.DataFrame:
    """Distinct words, those that stand once, uses of the five most frequent, words equal to the one before, distinct runs of two and of three; mean, 90th percentile and variation of letters and of syllables."""
    rows = []
    for w in words:
        w = list(w)
        counts = Counter(w)
        row = [len(counts), sum(c == 1 for c in counts.values()), sum(c for _, c in counts.most_common(5)), sum(a == b for a, b in pairwise(w)), len(set(pairwise(w))), len(set(zip(w, w[1:], w[2:])))]  # noqa: B905
        for size in (len, syllables):
            x = np.fromiter(map(size, w), float, len(w))
            m = x.mean() if len(w) else None
            row += [m, np.percentile(x, 90) if len(w) else None, x.std() / m if len(w) > 1 else None]
        rows.append(row)
    return pd.DataFrame(rows, columns=_COUNTS, dtype=float)


@F.pandas_udf(DoubleType())
def entropy(values: pd.Series) -> pd.Series:
    """Entropy in nats of the shares of distinct values; 0 for fewer than two values."""
    return pd.Series([math.log(len(v)) - sum(c * math.log(c) for c in Counter(v).values()) / len(v) if len(v) > 1 else 0.0 for v in values], dtype=float)


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def surface(df: DataFrame, text: str = "text") -> DataFrame:
    """df with METRICS as columns of doubles. Null and empty texts have counts of 0 and null for the rest."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("double")
    full = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"\S"))
    sentences = F.filter(F.regexp_extract_all("_t", F.lit(SENTENCE), F.lit(0)), lambda x: x.rlike(r"\S"))
    rows = df.withColumn("_t", t).withColumns({"_n": F.length("_t").cast("double"), "_w": _words(F.col("_t")), "_l": F.transform(full, lambda x: F.regexp_replace(x, r"\s+$", "")), "_s": F.transform(sentences, lambda x: F.regexp_count(x, F.lit(WORD)).cast("double"))})
    rows = rows.withColumns({"_c": word_counts("_w"), "_k": F.size("_w").cast("double"), "_m": F.size(F.array_distinct(F.regexp_extract_all("_t", F.lit(MARKS), F.lit(0)))).cast("double")})
    some, k, n = F.col("_n") > 0, F.col("_k"), F.col("_n")
    of_text = lambda x: F.when(some, x / n)
    of_words = lambda x: F.when(k > 0, x / k)
    share = lambda hit: F.when(F.size("_l") > 0, F.size(F.filter("_l", hit)) / F.size("_l").cast("double"))
    symbols = lambda x: F.regexp_count(x, F.lit(SYMBOLS))
    code = lambda x: x.rlike(CODE) | (symbols(x) / F.greatest(F.lit(1), symbols(x) + F.regexp_count(x, F.lit(r"\p{L}"))) >= 0.33)
    values = [
        n, of_text(count(r"\p{L}")), of_text(count(r"\p{Nd}")), of_text(count(SYMBOLS)), of_text(count(r"\s")), F.when(some, F.col("_m")), F.when(n >= 200, F.col("_m") / (n / 1000)), k, F.col("_c.unique"), of_words(F.col("_c.unique")), of_words(F.col("_c.once")),
        of_words(F.col("_c.five")), F.when(k >= 2, F.col("_c.repeats") / (k - 1)), F.when(k >= 3, 1 - F.col("_c.pairs") / (k - 1)), F.when(k >= 3, 1 - F.col("_c.triples") / (k - 2)),
        *[F.when(~F.isnan(f"_c.{x}_{y}"), F.col(f"_c.{x}_{y}")) for x in ("len", "syl") for y in ("mean", "p90", "cv")], F.when(some, mean(F.col("_s"))), F.when(some, quantile(F.array_sort("_s"), 0.9)), variation(F.col("_s")),
        share(code), *[share(_matches(p)) for p in LINES.values()],
    ]
    return rows.withColumns(dict(zip(METRICS, [v.cast("double") for v in values], strict=True))).drop("_t", "_n", "_w", "_l", "_s", "_c", "_k", "_m")


def _literal(phrase: str) -> str:
    return phrase.replace("-", r"\-")


def taxonomy(df: DataFrame, text: str = "text") -> DataFrame:
    """df with TAXONOMY as columns of doubles; blank texts have 0 throughout. Rates of marks and phrases are per 100 words."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    full = lambda a: F.filter(a, lambda x: x.rlike(r"\S"))
    sentences = lambda x: full(F.split(x, AFTER_SENTENCE))
    rows = df.withColumn("_t", t).withColumns({"_w": _words(F.col("_t")), "_s": sentences(F.col("_t")), "_p": F.transform(full(F.split("_t", BREAK)), sentences)})
    first = F.transform("_s", lambda s: F.array_join(F.transform(F.slice(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), 1, 3), lambda w: F.lower(w)), " "))
    lens = F.transform("_p", lambda p: _sum(F.transform(p, lambda s: F.regexp_count(s, F.lit(WORD)).cast("double"))) / F.size(p))
    rows = rows.withColumns({"_o": entropy(F.filter(first, lambda x: x != "")), "_a": lens, "_k": F.greatest(F.lit(1), F.size("_w")).cast("double"), "_low": F.lower("_t")})
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("double")
    per = lambda x: 100 * x / F.col("_k")
    of = lambda a, hit: F.size(F.filter(a, hit)) / F.greatest(F.lit(1.0), F.size(a).cast("double"))
    within = lambda words: F.size(F.filter("_w", lambda w: w.isin(*words))) / F.col("_k")
    phrases = lambda ps: sum((F.regexp_count("_low", F.lit(_literal(p))) for p in ps[1:]), F.regexp_count("_low", F.lit(_literal(ps[0]))))
    m = mean(F.col("_a"))
    spread = F.sqrt(F.greatest(F.lit(0.0), _sum(F.transform("_a", lambda x: x * x)) / F.size("_a") - m * m))
    values = [
        per(count(",")), per(count(";")), per(count("—|–| - ")), per(count(":")), of("_s", lambda s: s.rlike(r"\?\s*$")), of("_s", lambda s: s.rlike(r"!\s*$")), of("_p", lambda p: F.size(p) <= 1), within(FUNCTION_WORDS), within(MARKERS), per(F.least(count(r"\("), count(r"\)"))),
        per(phrases(WORN)), per(phrases(HEDGING)), F.col("_o"), F.when(F.size("_a") >= 2, spread / F.greatest(m, F.lit(1e-12))).otherwise(0.0),
    ]
    blank = F.col("_t") == ""
    return rows.withColumns({k: F.when(blank, 0.0).otherwise(v.cast("double")) for k, v in zip(TAXONOMY, values, strict=True)}).drop("_t", "_w", "_s", "_p", "_o", "_a", "_k", "_low")
