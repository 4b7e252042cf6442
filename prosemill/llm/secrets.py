"""Secret scans with ownership frequency across the corpus.

Rules give base spans. Further candidates are long tokens of mixed letters and digits outside base spans. All matched values are counted by hash over the
corpus: distinct repositories and distinct owners. A value that `example_owners` owners or `example_repositories` repositories or more hold is a copied
example; one that few hold is owner-specific and looks live. Live-looking candidates become spans of kind `owned`; base spans stay whatever their class.

Text is read once: what it yields (spans and hashes) is written to the shared folder, and counting works on that alone. Counting pre-aggregates by
(hash, repository, owner), so a value in a third of all rows costs each task one row. Hashes of examples are sent to all tasks if they have few bytes; beyond that, each
row's distinct hashes are joined with them under a salt, so that one example's occurrences are dealt to several tasks. Built-in functions only.

Defined cases: a null or empty text has no spans; a null repository or owner counts as one of its own; repeated rows each get their spans; equal starts
are ordered by kind as listed; other columns pass through, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the base rules: kind, cheap test, pattern, group whose length counts, least length.
RULES = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 0, 24),
]
KINDS = [r[0] for r in RULES] + ["owned"]
#: Further candidates, and the distinct characters that one has at least.
CANDIDATE, LEAST, DISTINCT = r"[A-Za-z0-9+/_=-]{20,}", 20, 10
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, number: int, test: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of the pattern whose group has `least` characters: what lies between matches gives their places in code points."""
    gaps, found, held = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("all"), held.alias("held"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        stop = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), x["held"].alias("value"))
        return F.struct(F.coalesce(stop, s["at"]).cast("int").alias("at"), F.when(F.length(x["held"]) >= least, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(text.rlike(test), F.aggregate(rows, zero, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None, example_owners: int = 3, example_repositories: int = 6, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """A row per row of df: key, row_id, text_hash, base and owned (arrays of spans), n_live and n_example (base values by class)."""
    repository, owner = (F.col("source") if repository is None else repository), (F.col("source") if owner is None else owner)
    t = F.coalesce(F.col("_t"), F.lit(""))
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_x"), repository.cast("string").alias("_r"), owner.cast("string").alias("_o"))
    rows = rows.withColumns({f"_s{i}": _spans(t, i, test, pattern, group, least) for i, (_, test, pattern, group, least) in enumerate(RULES)})
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT)
    rows = rows.withColumn("_base", F.concat(*[F.col(f"_s{i}") for i in range(len(RULES))])).withColumn("_more", _spans(t, len(RULES), rf"[A-Za-z0-9+/_=-]{{{LEAST}}}", CANDIDATE, 0, LEAST))
    apart = lambda x: mixed(x["value"]) & ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.xxhash64(x["value"]).alias("hash")))
    found = materialise(rows.select("_k", "_x", "_r", "_o", F.monotonically_increasing_id().alias("_id"), hashed(F.col("_base")).alias("base"), hashed(F.filter("_more", apart)).alias("more")), "secrets")
    each = found.select("_id", "_r", "_o", F.explode(F.concat("base", "more")).alias("s"))
    own = each.select(F.col("s.hash").alias("hash"), "_r", "_o").groupBy("hash", "_r", "_o").count()
    owners = own.groupBy("hash").agg(F.count_distinct(F.struct("_r")).alias("repositories"), F.count_distinct(F.struct("_o")).alias("owners"))
    shared = owners.where((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)).select(F.col("hash").alias("_h"), F.lit(True).alias("example"))
    shared = materialise(shared, "secrets-examples")
    marked = each.select("_id", "s", F.col("s.hash").alias("_h"))
    if 16 * shared.count() <= broadcast_bytes:
        marked = marked.join(F.broadcast(shared), "_h", "left")
    else:
        salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        marked = marked.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(16)).cast("int")).join(salted, ["_h", "_salt"], "left")
    live = F.col("example").isNull()
    per = marked.groupBy("_id").agg(
        F.collect_list(F.when(live & (F.col("s.kind") == len(RULES)), F.col("s"))).alias("owned"),
        F.count_if(live & (F.col("s.kind") < len(RULES))).alias("n_live"), F.count_if(~live & (F.col("s.kind") < len(RULES))).alias("n_example"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,hash:bigint>>")
    out = found.join(per, "_id", "left")
    return out.select(F.col("_k").alias(key), F.col("_id").alias("row_id"), F.col("_x").alias("text_hash"), "base", F.coalesce("owned", none).alias("owned"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def masked(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced."""

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(by))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when((x["start"] < s["at"]) | ((x["start"] == s["at"]) & (s["at"] > 0)), s["out"]).otherwise(new).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
