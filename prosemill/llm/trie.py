"""Prefix trie of conversations: a node for each distinct sequence of first turns, with what its subtree holds.

A turn is its digest (128 bits of role and text) and its number of words; texts are left behind in the first scan. Equal conversations become one
sequence with a weight before anything is built, so copies cost one row each. Sequences are dealt by the digest of their first turn; small subtries
share buckets, and each bucket builds its tries from dictionaries of child pointers in applyInPandas and sums them in an iterative postorder.

A subtrie with more than `most` turns is split instead: the turns that all its sequences share form its spine, told by one aggregation over (group,
place), and what follows is dealt again by the next turn. A spine needs no task of its own: its nodes are rows, its sums come from the summaries of its
parts, from the deepest split upwards. A long conversation that shares no more turns with any other is a spine as a whole, however long. So a
round ends in a branching of each group that it splits, and no task holds more than `most` turns or one bucket.

Turns are numbered by ranges of (conversation, turn), so that one conversation with a third of all rows is dealt to many tasks. The digest of the
conversations that end at a node is a hash of one string of sorted ids: sha256 is sequential, so the ids of equal conversations stream through one task,
which holds a hash state and no list.

Defined cases: a null conversation id belongs to no conversation and is left out; a null turn comes first; equal turns are ordered by digest; repeated
rows are turns each; null role or text is empty; extra columns are ignored, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, crc_bucket, materialise

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv, place (from 1), digest, words."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    words = F.size(F.filter(F.split(text_, f"{BLANK_CLASS}+"), lambda w: w != "")).cast("long")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))).alias("digest"), words.alias("words"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("conv", "turn", "digest", "_row").sortWithinPartitions("conv", "turn", "digest")
    rows = materialise(rows.select("conv", "digest", "words", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "trie-turns")
    piece = rows.groupBy("conv", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    piece = piece.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(piece, ["conv", "_part"]).select("conv", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("place"), "digest", "words")


def borrowed(rows: DataFrame, base: Column, first: Column, most_first: int) -> DataFrame:
    """A row per turn of rebuilt conversations, and one with place null for each that has no turn: the first turns of the conversation `base`, then the own ones after as many.

    base and first are expressions over conv; first is most_first at most."""
    convs = rows.groupBy("conv").agg(F.max("place").alias("n")).withColumns({"base": base, "first": first})
    heads = rows.where(F.col("place") <= most_first).select(F.col("conv").alias("base"), "place", "digest", "words")
    size = heads.groupBy("base").agg(F.max("place").alias("base_n"))
    convs = convs.join(size, "base", "left").withColumn("taken", F.least("first", F.coalesce("base_n", F.lit(0))))
    taken = convs.select("conv", "base", "taken").join(heads, "base").where(F.col("place") <= F.col("taken")).select("conv", "place", "digest", "words")
    own = rows.where(F.col("place") > first).join(convs.select("conv", "first", "taken"), "conv")
    own = own.select("conv", (F.col("place") - F.col("first") + F.col("taken")).alias("place"), "digest", "words")
    bare = convs.where((F.col("n") <= F.col("first")) & (F.col("taken") == 0)).select("conv", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(bare)


def _sequences(rows: DataFrame) -> DataFrame:
    """A row per distinct sequence: conv (smallest), n, size, top (digest of the first turn), ends_sha256."""
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", "digest")).alias(f"x{salt}")
    convs = rows.groupBy("conv").agg(mark(1), mark(2), F.count("place").alias("size"), F.max(F.when(F.col("place") == 1, F.col("digest"))).alias("top"))
    same = ["size", "x1", "x2"]
    convs = materialise(convs, "trie-conversations")
    classes = convs.groupBy(same).agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.first("top", True).alias("top"))
    many = classes.where("n > 1").select(*same, "rep")
    of = convs.join(many, same).select("rep", "conv")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            reps, out = batch.column(0).to_pylist(), ([], [])
            for rep, conv in zip(reps, batch.column(1).to_pylist(), strict=True):
                if rep != now:
                    if state:
                        out[0].append(now)
                        out[1].append(state.hexdigest())
                    now, state = rep, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["rep", "hash"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["rep", "hash"])

    found = of.repartition("rep").sortWithinPartitions("rep", "conv").mapInArrow(hashes, "rep long, hash string")
    alone = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    return classes.join(found, "rep", "left").select(F.col("rep").alias("conv"), "n", "size", "top", F.coalesce("hash", alone).alias("ends_sha256"))


class _Tries:
    """Tries of a bucket as columns of nodes; children are dictionaries from digest to node."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int]] = []
        self.parent, self.depth, self.conv, self.n, self.words, self.ends, self.group = ([] for _ in range(7))

    def node(self, parent: int, depth: int, words: int, group: bytes) -> int:
        self.children.append({})
        for column, value in ((self.parent, parent), (self.depth, depth), (self.conv, None), (self.n, 0), (self.words, words), (self.ends, _EMPTY), (self.group, group)):
            column.append(value)
        return len(self.children) - 1

    def sums(self, roots: list[int]) -> tuple[list[int], list[int]]:
        """Leaves and saved tokens of each node's subtree: an iterative postorder, where a node is closed after all its children."""
        leaves, saved = [0] * len(self.parent), [0] * len(self.parent)
        for root in roots:
            stack = [(root, iter(self.children[root].values()))]
            while stack:
                at, rest = stack[-1]
                child = next(rest, None)
                if child is not None:
                    stack.append((child, iter(self.children[child].values())))
                    continue
                stack.pop()
                leaves[at] = leaves[at] or 1
                saved[at] += (self.n[at] - 1) * self.words[at]
                if self.parent[at] >= 0:
                    leaves[self.parent[at]] += leaves[at]
                    saved[self.parent[at]] += saved[at]
        return leaves, saved


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all tries of a bucket. Rows: grp, up (smallest member of the group's parent), conv, n, ends_sha256, place, digest, words."""
    pdf = pdf.sort_values(["grp", "conv", "place"], kind="stable")
    tries, tops, ups = _Tries(), {}, []
    heads: dict[bytes, dict[bytes, int]] = {}
    now, at, last = None, -1, None
    for grp, up, conv, n, ends, place, digest, words in zip(*(pdf[c].tolist() for c in ("grp", "up", "conv", "n", "ends_sha256", "place", "digest", "words")), strict=True):
        if (grp, conv) != now:
            if last is not None:
                tries.ends[at] = last
            now, at, last = (grp, conv), -1, ends
        kids = tries.children[at] if at >= 0 else heads.setdefault(grp, {})
        nxt = kids.get(digest)
        if nxt is None:
            nxt = kids[digest] = tries.node(at, place, words, grp)
            if at < 0:
                tops[nxt] = up
        at = nxt
        tries.conv[at] = conv if tries.conv[at] is None else min(conv, tries.conv[at])
        tries.n[at] += n
    if last is not None:
        tries.ends[at] = last
    leaves, saved = tries.sums(list(tops))
    ups = [tops[i] if p < 0 else tries.conv[p] for i, p in enumerate(tries.parent)]
    cols = {"conv_id": tries.conv, "depth": tries.depth, "parent_conv_id": ups, "n_convs": tries.n, "n_children": [len(c) for c in tries.children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": tries.ends, "grp": tries.group}
    return pd.DataFrame(cols | {"is_top": [p < 0 for p in tries.parent]})


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of groups that are split: spine nodes, and the rows below with their new groups.

    Spine: grp, outer (the group that it is a part of), place, conv, n, words, up, ends_sha256 and n_children of its end."""
    facts = rows.groupBy("grp").agg(F.min("conv").alias("least"), F.min("place").alias("from"), F.max("place").alias("to"), F.first("up").alias("up"), F.first("outer", True).alias("outer"))
    level = rows.groupBy("grp", "place").agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("words").alias("words"), F.max(F.when(F.col("place") == F.col("size"), F.col("ends_sha256"))).alias("ended"), F.count_if(F.col("place") == F.col("size")).alias("enders"))
    level = materialise(level, "trie-levels")
    all_ = level.join(facts, "grp").where(F.col("place") == F.col("from")).select("grp", F.col("seqs").alias("all"), "least", "from", "to", "up", "outer")
    odd = level.join(all_, "grp").where((F.col("low") != F.col("high")) | (F.col("seqs") < F.col("all"))).groupBy("grp").agg(F.min("place").alias("odd"))
    ends = materialise(all_.join(odd, "grp", "left").withColumn("until", F.coalesce(F.col("odd") - 1, F.col("to"))).drop("odd"), "trie-spines")
    below = rows.join(ends.select("grp", "until", F.col("least").alias("_up")), "grp").where(F.col("place") > F.col("until"))
    nxt = below.where(F.col("place") == F.col("until") + 1).select("grp", "conv", F.unhex(F.md5(F.concat("grp", "digest"))).alias("_grp"))
    fanout = below.where(F.col("place") == F.col("until") + 1).groupBy("grp").agg(F.count_distinct("digest").alias("fanout"))
    spine = level.join(ends, "grp").where(F.col("place") <= F.col("until")).join(fanout, "grp", "left")
    last = F.col("place") == F.col("until")
    spine = spine.select(
        "grp", "outer", "place", F.col("least").alias("conv"), "n", "words", F.when(F.col("place") == F.col("from"), F.col("up")).otherwise(F.col("least")).alias("up"), (F.col("place") == F.col("from")).alias("is_top"),
        F.when(last, F.coalesce("fanout", F.lit(0))).otherwise(F.lit(1)).alias("n_children"), F.when(last & (F.col("enders") > 0), F.col("ended")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    parts = below.join(nxt, ["grp", "conv"]).select(F.col("_grp").alias("grp"), F.col("grp").alias("outer"), F.col("_up").alias("up"), "conv", "n", "size", "ends_sha256", "place", "digest", "words")
    return materialise(spine, "trie-spine"), materialise(parts, "trie-parts")


def nodes(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Nodes of the trie of conversations, from a row per turn (conv, place, digest, words; place null: no turns). most: turns of a subtrie that one task builds."""
    spark = rows.sparkSession
    rows = materialise(rows, "trie-rebuilt")
    sequences = materialise(_sequences(rows), "trie-sequences")
    root = sequences.agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max(F.when(F.col("size") == 0, F.col("ends_sha256"))).alias("ends_sha256")).where("conv is not null")
    least = root.select("conv").first()
    if least is None:
        return spark.createDataFrame([], NODE)
    now = rows.join(sequences.where("size > 0"), "conv").select(F.col("top").alias("grp"), F.lit(None).cast("binary").alias("outer"), F.lit(least[0]).alias("up"), "conv", "n", "size", "ends_sha256", "place", "digest", "words")
    found: list[DataFrame] = []  # what tries gave, by round
    spines: list[DataFrame] = []
    while True:
        sizes = materialise(now.groupBy("grp").agg(F.count("*").alias("_turns")), "trie-sizes")
        large = sizes.where(F.col("_turns") > most).select("grp")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum("_turns")).first()[0] or 0) // most + 1)
        small = now.join(large, "grp", "left_anti").withColumn("_bucket", F.pmod(F.xxhash64("grp"), F.lit(tasks)))
        outer = small.select("grp", "outer").distinct() if spines else None
        kind = f"{NODE}, grp binary, is_top boolean"
        made = materialise(small.groupBy("_bucket").applyInPandas(lambda pdf: _build(pdf), kind), "trie-nodes")
        found.append((made, outer))
        if large.isEmpty():
            break
        spine, now = _split(now.join(large, "grp", "left_semi"))
        spines.append(spine)
    tops = lambda made, outer: made.where("is_top").join(outer, "grp").select(F.col("outer").alias("grp"), "n_leaves", "saved_tokens") if outer is not None else None
    columns, out = [x.split()[0] for x in NODE.split(", ")], [found[0][0]]
    above: DataFrame | None = None  # summaries of parts, by the group that they are parts of
    for i in range(len(spines) - 1, -1, -1):
        own = tops(*found[i + 1])
        above = own if above is None else own.unionByName(above)
        sums = above.groupBy("grp").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        down = Window.partitionBy("grp").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
        spine = spines[i].withColumn("_own", F.sum((F.col("n") - 1) * F.col("words")).over(down)).join(sums, "grp", "left")
        spine = materialise(spine.select(
            F.col("conv").alias("conv_id"), F.col("place").alias("depth"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
            F.coalesce("_leaves", F.lit(1)).alias("n_leaves"), (F.col("_own") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"), "ends_sha256", "grp", "outer", "is_top",
        ), "trie-summed")
        out += [spine, found[i + 1][0]]
        above = spine.where("is_top").select(F.col("outer").alias("grp"), "n_leaves", "saved_tokens")
    first = found[0][0].where("is_top").select("n_leaves", "saved_tokens")
    first = first if above is None else first.unionByName(above.select("n_leaves", "saved_tokens"))
    total = first.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    top = root.crossJoin(total).select(  # one row and one row
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    for part in out:
        top = top.unionByName(part.select(columns))
    return top


def by_twenties(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The trie of conversations that take their first turns (crc32 of the id, modulo 4) from the conversation whose id is the next lower multiple of 20."""
    conv = F.col("conv")
    return nodes(borrowed(turns(df), conv - conv % 20, crc_bucket(conv, 4), 3), most)
