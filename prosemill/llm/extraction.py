"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A page is a sequence of tokens: tags with their class and id, and runs of text; sections without class and id have their role by their place in the parent section. A token's occurrence vector over a host's pages is kept as a fingerprint that sums in
any order (the exclusive or of hashes of row and count), so tokens with equal vectors are found by one aggregation with map-side sums, however many
pages a host has. A class of two tokens or more is a candidate if its share of pages reaches `support`; the share is that of the host's pages and of `prior` pages
more that have the token as often as all hosts together, so one rule serves hosts of any size.

A second pass verifies classes on every page: a class is valid if its tokens come in one order everywhere (over and over, if its vector has counts above one) and if
it lies within one gap of one and the same class, or outside all. The valid classes, nested so, are the host's template. Its open tags of sections (div, body, article, ...) bound regions; what stands
between two neighbouring template tokens is a slot, and belongs to the innermost region open there. The region whose slots hold most words outside links, over all pages, is the
main one; article and main elements count twice. Regions within it are left out if their slots are mostly links, if they are such by tag or by their one class or id (ad, comments, ...), if such a word is part of their names and they hold less than a fifth of the main region's words, or if the main region has no name and they hold less than a tenth.

The text of a page is that of its main region: slots, without runs of text that are template tokens. Elements that never hold content (nav, form, script, ...) and those whose one
class or id is such a name (ad, comments, ...) are left out wherever they stand. If the main region holds template text alone, as in copies of one page, all of it is content. A page without its host's main region gives
the text of its article or main elements, or else of all slots outside regions left out, in page order.

Defined cases: null or empty html has an empty text; a null url or one without a host counts as the host ""; repeated rows each get their text; unclosed elements end with
their parents; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:"[^"]*"|'[^']*'|[^>"'])*>|[^<]+|<""", re.S | re.I)
_NAME, _MARK = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)"), re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements that never hold content, elements that start a block, elements without an end, and elements that a new block closes.
APART = set("nav footer aside form button select option head title noscript script style template iframe svg textarea dialog menu".split())
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th section article main blockquote pre header footer nav aside figure figcaption hr form address body html head title".split())
INLINE = set("p b i em strong".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what isn't content.
NAMES = set(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "signup comment comments respond reply replies discussion disqus share sharing social related recommended pagination pager toolbar skip hidden".split()
)
_WORD = re.compile(r"[a-z0-9]+")
#: Elements that bound regions.
SECTIONS = set("body div section article main td header footer nav aside form".split())
#: Sections that without marks are told apart by their place among those of their parent.
BARE = set("div section td".split())
#: Parts of the page that never hold content, whatever the template.
_HEAD = {"head", "title"}


def _sign(run: str) -> str:
    return f"#{xxhash.xxh64_hexdigest(run.encode('utf-8', 'surrogatepass'))}"


class Page:
    """Tokens of a page: (signature, tag or text, apart): the signature is the tag with its marks, or a run of text's hash ('' for blank runs); apart: whether the element holds no content by tag or by its one name."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, bool]] = []
        open_: list[tuple[str, str, dict[str, int]]] = [("", "", {})]  # tag, role and children by tag of the open sections
        for m in _TOKEN.finditer(source):
            t = m[0]
            if t[0] != "<" or t == "<":
                run = t.strip()
                self.tokens.append((_sign(run) if run else "", t, False))
            elif t.startswith(("<!", "<?")) or m[1]:
                continue  # comments, declarations, scripts and styles
            elif n := _NAME.match(t):
                tag = n[1].lower()
                marks = " ".join(x.strip("\"'").lower() for x in _MARK.findall(t)) if "=" in t else ""
                close = t[1] == "/"
                away = not close and (tag in APART or marks in NAMES)
                role = f"<{tag} {marks}>" if marks else f"<{tag}>"
                if tag in SECTIONS:
                    if close:
                        at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == tag), 0)
                        role = f"<{tag}>" if not at else open_[at][1]
                        del open_[at or len(open_) :]
                    else:
                        place = open_[-1][2][tag] = open_[-1][2].get(tag, 0) + 1
                        if not marks and tag in BARE:
                            role = f"<{tag}>@{place}{open_[-1][1][-200:]}"
                        open_.append((tag, role, {}))
                self.tokens.append((f"</{role[1:]}" if close else role, tag, away))

    def signatures(self) -> Counter[str]:
        """Number of each token."""
        return Counter(sign for sign, _, _ in self.tokens if sign)

    def walk(self) -> Iterator[tuple[int, str, str, bool, list[tuple[str, str, bool]]]]:
        """Number, signature, tag or text, apart, and the open elements (tag, signature, apart) of each token, where unclosed elements end with their parents."""
        stack: list[tuple[str, str, bool]] = []
        for i, (sign, value, away) in enumerate(self.tokens):
            if sign[:1] != "<":
                yield i, sign, value, False, stack
                continue
            if sign[1] == "/":
                if any(t == value for t, _, _ in stack):
                    while stack.pop()[0] != value:
                        pass
            elif value not in VOID:
                if value == "p" and stack and stack[-1][0] in INLINE:  # a paragraph ends an open one
                    while stack and stack[-1][0] in INLINE:
                        stack.pop()
                stack.append((value, sign, away or bool(stack) and stack[-1][2]))
            yield i, sign, value, away, stack

    def classes(self, of: dict[str, int]) -> list[tuple[int, str, int, int]]:
        """class, its tokens in order, the class around it (-1: none, -2: it crosses one) and the gap there, for the classes of `of` (token: class) on this page."""
        places: dict[int, list[int]] = {}
        for i, (sign, _, _) in enumerate(self.tokens):
            if (c := of.get(sign)) is not None:
                places.setdefault(c, []).append(i)
        out, stack = [], []
        for c, at in sorted(places.items(), key=lambda x: (x[1][0], -x[1][-1])):
            signs = [self.tokens[i][0] for i in at]
            k = len(set(signs))
            order = "\0".join(signs[:k] if signs == signs[:k] * (len(signs) // k) else [])
            while stack and places[stack[-1]][-1] < at[0]:
                stack.pop()
            parent, gap = -1, 0
            if stack:
                around = places[stack[-1]]
                gap = bisect(around, at[0])
                parent = stack[-1] if around[-1] > at[-1] and bisect(around, at[-1]) == gap else -2
                period = len({self.tokens[i][0] for i in around})
                gap %= period
            out.append((c, order, parent, gap))
            stack.append(c)
        return out

    def slots(self, of: dict[str, int]) -> dict[str, list[int]]:
        """Words and words in links of the slots, and words of template runs, by the chain of open regions (signatures of template tokens, outermost first)."""
        out: dict[str, list[int]] = {}
        for _, sign, value, _, stack in self.walk():
            if sign[:1] != "#" or (stack and (stack[-1][2] or stack[-1][0] in _HEAD)):
                continue
            chain = "\0".join(s for t, s, _ in stack if t in SECTIONS and s in of)
            x = out.setdefault(chain, [0, 0, 0])
            n = len(value.split())
            if sign in of:
                x[2] += n
            else:
                x[0] += n
                x[1] += n * any(t == "a" for t, _, _ in stack)
        return out

    def text(self, template: set[str], main: str | None, out: set[str]) -> str:
        """Blocks of the main region (of all, if the page has none) outside regions left out and elements apart; template text alone makes no block, unless there is nothing else."""
        content: list[str] = []
        repeated: list[str] = []
        held: list[str] = []
        fresh, inside = False, False
        ours = (lambda t, s: s == main) if main and any(sign == main for sign, _, _ in self.tokens) else (lambda t, s: t in ("article", "main"))
        whole = not any(sign[:2] != "</" and sign[:1] == "<" and ours(tag, sign) for sign, tag, _ in self.tokens)

        def end() -> None:
            nonlocal fresh
            if t := " ".join("".join(held).split()):
                (content if fresh else repeated).append(t)
            held.clear()
            fresh = False

        inside = whole
        for _, sign, value, away, stack in self.walk():
            if sign[:1] == "<":
                if value == "br":
                    held.append(" ")
                elif value in BLOCKS or away or sign in out:
                    end()
                inside = (whole or any(ours(t, s) for t, s, _ in stack)) and not any(gone or t in _HEAD or (s in out and not ours(t, s)) for t, s, gone in stack)
            elif inside:
                fresh |= bool(sign) and sign not in template
                held.append(entities.unescape(value))
        end()
        return "\n".join(content or ([] if whole else repeated))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def candidates(rows: DataFrame, support: float, prior: int) -> DataFrame:
    """host, print (of a class) and tokens: classes of equal occurrence vectors whose smoothed share of pages reaches `support`."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        held: dict[tuple[str, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(held.keys()), list(held.values())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([v[i] for v in values], pa.int64()) for i in range(2)]], ["host", "token", "pages", "print"])

        for part_, sources in chunks(batches, "_html"):
            for url, source in zip(part_.column(part_.schema.get_field_index("_url")).to_pylist(), sources, strict=True):
                row += 1
                host = host_of(url)
                for token, count in {**Page(source).signatures(), "": 1}.items():
                    x = held.setdefault((host, token), [0, 0])
                    x[0], x[1] = x[0] + 1, x[1] ^ (xxhash.xxh64_intdigest(f"{part} {row} {count}") - 2**63)
            if len(held) > 300_000:
                yield out()
                held.clear()
        yield out()

    found = rows.mapInArrow(tally, "host string, token string, pages long, print long").groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("print").alias("print"))
    found = materialise(found.where("pages > 1 or token = '' or token like '<%'"), "page-tokens")  # a run of text on one page is in no template
    total = found.where("token = ''").select("host", F.col("pages").alias("all"))
    pool = found.where("token like '<%'").groupBy("token").agg(F.sum("pages").alias("everywhere"))
    pages = total.agg(F.coalesce(F.sum("all"), F.lit(1))).first()[0]
    held = found.where("token <> ''").join(total, "host").join(pool, "token", "left")
    share = (F.col("pages") + prior * F.coalesce("everywhere", F.lit(0)) / F.lit(float(pages))) / (F.col("all") + prior)
    classes = held.where(share >= support).groupBy("host", "print").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return materialise(classes.where(F.size("tokens") > 1), "page-classes")


def _with_host(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return rows.withColumn("_host", name)


def _joined(rows: DataFrame, info: DataFrame, size: Column, broadcast_bytes: int, salts: int = 16) -> DataFrame:
    """The pages with what is known of their hosts: sent to all executors if it has few bytes, else joined by host and a salt, so that a large host is dealt to several tasks."""
    if (info.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(info), "_host", "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_url", "_html"), F.lit(salts)))
    return salted.join(info.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["_host", "_salt"], "left").drop("_salt")


def templates(rows: DataFrame, support: float, prior: int, broadcast_bytes: int) -> DataFrame:
    """_host, template (tokens of valid classes), main (signature of the main region's open tag) and out (those of regions within it that are no content)."""
    classes = candidates(rows, support, prior)
    by_host = classes.groupBy("host").agg(F.collect_list("tokens").alias("classes")).withColumnRenamed("host", "_host")
    known = materialise(_joined(_with_host(rows), by_host, F.expr("aggregate(flatten(classes), 0, (s, x) -> s + length(x) + 8)"), broadcast_bytes).select("_host", "_html", "classes").where("classes is not null").mapInArrow(_seen, "host string, kind int, class int, what string, parent int, gap int, pages long, words long, links long, fixed long"), "page-structure")
    rows_ = known.groupBy("host", "kind", "class", "what", "parent", "gap").agg(*[F.sum(c).alias(c) for c in ("pages", "words", "links", "fixed")])
    seen = materialise(rows_, "page-structures")
    one = seen.where("kind = 0").groupBy("host", "class").agg(F.count("*").alias("ways"), F.first("what").alias("order"), F.first("parent").alias("parent"))
    valid = one.where("ways = 1 and order <> '' and parent <> -2").select("host", F.explode(F.split("order", "\0")).alias("token"))
    template = valid.groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("template"))
    slots = seen.where("kind = 1").join(template, "host")
    regions = slots.select("host", F.filter(F.split("what", "\0"), lambda x: F.array_contains("template", x)).alias("chain"), "words", "links", "fixed").where(F.size("chain") > 0)
    regions = regions.groupBy("host", F.get("chain", F.size("chain") - 1).alias("region")).agg(F.first("chain").alias("chain"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.sum("fixed").alias("fixed"))
    tag, marks = F.regexp_extract("region", r"^<([a-z0-9:-]+)", 1), F.regexp_extract("region", r"^<[a-z0-9:-]+ ?([^>]*)>", 1)
    named = marks.isin(*sorted(NAMES)) | tag.isin(*sorted(APART))
    hinted = F.exists(F.split("marks", "[^a-z0-9]+"), lambda w: F.array_contains(F.array(*[F.lit(x) for x in sorted(NAMES)]), w))
    regions = regions.withColumns({"tag": tag, "marks": marks, "named": named, "free": F.col("words") - F.col("links")})
    weight = lambda c: F.when(F.col("named"), 0).otherwise(F.col(c) * F.when(F.col("tag").isin("article", "main"), 2).otherwise(1))
    best = regions.groupBy("host").agg(F.max(F.struct(weight("free").alias("weight"), weight("fixed").alias("fixed"), F.col("region").alias("main"), F.col("free").alias("most"), (F.col("marks") == "").alias("bare"), F.col("tag").alias("main_tag"))).alias("b")).where("b.weight > 0 or b.fixed > 0").select("host", "b.main", "b.most", "b.bare", "b.main_tag")
    small = F.when(hinted, F.col("free") * 5 < F.col("most")).otherwise(F.col("bare") & ~F.col("main_tag").isin("article", "main") & (F.col("free") * 10 < F.col("most")))
    out = regions.join(best, "host").where((F.col("region") != F.col("main")) & F.array_contains("chain", F.col("main")) & (F.col("named") | (2 * F.col("links") > F.col("words")) | small))
    out = out.groupBy("host").agg(F.array_sort(F.collect_set("region")).alias("out"))
    found = template.join(best.select("host", "main"), "host", "left").join(out, "host", "left")
    return materialise(found.withColumnRenamed("host", "_host"), "page-templates")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the ways in which classes stand on pages (kind 0) and of slots by their regions (kind 1)."""
    names = ["host", "kind", "class", "what", "parent", "gap", "pages", "words", "links", "fixed"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    held: dict[tuple, list[int]] = {}
    maps: dict[str, tuple[list[list[str]], dict[str, int]]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*(k + tuple(v) for k, v in held.items()), strict=True)) or [[]] * len(names)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for part, sources in chunks(batches, "_html"):
        for host, classes, source in zip(part.column(part.schema.get_field_index("_host")).to_pylist(), part.column(part.schema.get_field_index("classes")), sources, strict=True):
            if host not in maps:
                if len(maps) > 2000:
                    maps.clear()
                numbered = sorted(classes.as_py())  # the same numbers in every task
                maps[host] = numbered, {t: i for i, c in enumerate(numbered) for t in c}
            of, page = maps[host][1], Page(source)
            for c, order, parent, gap in page.classes(of):
                held.setdefault((host, 0, c, order, parent, gap), [0, 0, 0, 0])[0] += 1
            for chain, (words, links, fixed) in page.slots(of).items():
                x = held.setdefault((host, 1, -1, chain, -1, -1), [0, 0, 0, 0])
                x[0], x[1], x[2], x[3] = x[0] + 1, x[1] + words, x[2] + links, x[3] + fixed
        if len(held) > 100_000:
            yield out()
    yield out()


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", support: float = 0.5, prior: int = 2, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """A row per row of df: key, url, text."""
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    found = templates(rows, support, prior, broadcast_bytes)
    size = F.expr("aggregate(template, 0, (s, x) -> s + length(x) + 8) + aggregate(coalesce(out, array()), 0, (s, x) -> s + length(x) + 8)")
    rows = _joined(_with_host(rows), found, size, broadcast_bytes).select("_key", "_url", "_html", "_host", "template", "main", "out")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[set[str], str | None, set[str]]] = {}
        for part, sources in chunks(batches, "_html"):
            texts = []
            for i, (source, host) in enumerate(zip(sources, part.column(3).to_pylist(), strict=True)):
                if host not in held:
                    if len(held) > 2000:
                        held.clear()
                    held[host] = set(part.column(4)[i].as_py() or ()), part.column(5)[i].as_py(), set(part.column(6)[i].as_py() or ())
                texts.append(Page(source).text(*held[host]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["_key", "_url", "text"])

    return rows.mapInArrow(run, f"_key {kinds['_key']}, _url {kinds['_url']}, text string").withColumnRenamed("_key", key).withColumnRenamed("_url", url)
