"""Exact similarity join on word n-gram sets by grouped prefixes, and the components that its links form.

Sets of 64-bit hashes of n-grams. Equal sets are one class, named by a hash of the set. All n-grams get one order: first those whose hash lies under a bound (the universe), the rarer first, then
the others by hash. Classes whose sets differ by no more than the threshold allows share an n-gram among the first n - ceil(t * n) + 1 of each (the
prefix). n-grams of the universe that stand once in the corpus count as prefix places but need no list. Classes with equal prefixes and sizes are one group; lists of an
n-gram's groups give pairs of groups, filtered by size and by the n-gram's places in both (what comes after it bounds the intersection).

Only these expand into pairs of members. Each class has a sketch, one parity bit for each stretch of hashes; two sketches differ in no more bits than their
sets in members, so a pair whose sketches differ too much is no link and its sets are never fetched. The sets of the others are computed
again and compared.

Lists of more than LIGHT members (near copies by the thousand) don't expand. Blocks of a list, of sizes that may match, are compared by sketch: a first time each block meets itself alone and gives a spanning forest of the
pairs that may link, the most alike first. With the light lists' pairs these are verified and give components. A second time all pairs of different components meet; those within one, and so most of a list, are left out. What remains is verified
pair by pair, or, in a block with more than DENSE pairs a member, by counting along lists within the block. So rows grow with the members, not with their
pairs. Nothing is capped or sampled, and nothing but counts comes to the driver. Components come from alternating large and small stars.

Defined cases: null, empty and blank texts have no n-grams, link with nothing and are components of their own id; texts of fewer than n words are one n-gram of all
words; repeated rows are equal sets; a null id never names a component that has another id; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, words_of
from .pieces import flat_index

#: Share of hashes whose frequencies are counted, over 1 - t: so much that most prefixes lie within.
UNIVERSE = 1.4
#: Members of a list up to which it is joined by pairs; members in a block beyond, and pairs for a member of a block up to which they are listed.
LIGHT, BLOCK, DENSE = 32, 1024, 32
#: Words of 64 bits in the map of texts to fetch again, which is broadcast: its size is bounded whatever the input.
MAP_WORDS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of n-gram hashes of texts; a worker hashes each distinct word once while it remembers it."""

    def __init__(self, n: int, most: int = 500_000):
        self.n, self.most, self.index, self.hashes = n, most, {}, np.zeros(1 << 16, np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text."""
        found = [words_of(t) for t in texts]
        words = list(chain.from_iterable(found))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = {words[i] for i in miss.tolist()}
            if len(self.index) + len(new) > self.most:
                self.index, new, miss = {}, set(words), np.arange(len(words))
            n = len(self.index)
            while n + len(new) > len(self.hashes):
                self.hashes = np.resize(self.hashes, 2 * len(self.hashes))
            self.hashes[n : n + len(new)] = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            at[miss] = np.fromiter((self.index[words[i]] for i in miss.tolist()), np.int64, len(miss))
        out, hashes, begin = [], self.hashes[at], 0
        for ws in found:
            h = hashes[begin : begin + len(ws)]
            begin += len(ws)
            width = min(self.n, len(h))
            if not width:
                out.append(h)
                continue
            x = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
            out.append(np.unique(x))
        return out


def _name(s: np.ndarray) -> int:
    """The class of a set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of hashes with equal low bits; four bits a hash, rounded up to a power of 2."""
    width = max(256, 4 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, width: int) -> np.ndarray:
    """The sketch as it is with `width` bytes."""
    x = np.frombuffer(sketch, np.uint64)
    while 8 * len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _prefixes(df: DataFrame, n: int, percent: int, kind: str) -> DataFrame:
    """A row per row: _k, _h, class (null for an empty set), size, and, where this task meets the class first, its sketch, its n-grams in the universe and those of the prefix beyond."""
    under = np.uint64(int(min(0.99, UNIVERSE * (1 - percent / 100)) * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(n), set()
        for part, texts in chunks(batches, "_t"):
            names, sizes, sketches, inside, beyond = [], [], [], [], []
            for s in shingler.sets(texts):
                sizes.append(len(s))
                names.append(_name(s) if len(s) else None)
                if not len(s) or names[-1] in met:
                    sketches.append(None)
                    inside.append(None)
                    beyond.append(None)
                    continue
                met.add(names[-1])
                cut = int(np.searchsorted(s, under))
                length = len(s) - -(-percent * len(s) // 100) + 1
                sketches.append(_sketch(s))
                inside.append(_signed(s[:cut]))
                beyond.append(_signed(s[cut : cut + max(0, length - cut)]))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(inside, lists), pa.array(beyond, lists)], ["_k", "_h", "class", "size", "sketch", "inside", "beyond"])

    return df.mapInArrow(run, f"_k {kind}, _h long, class long, size long, sketch binary, inside array<long>, beyond array<long>")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of left with any need, the sizes of its intersections with all sets."""
    lens = np.array([len(s) for s in sets])
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lens)
    order = np.argsort(gram, kind="stable")
    count = np.bincount(gram)
    begin, starts = np.cumsum(count) - count, np.cumsum(lens) - lens
    owners = owner[order]
    for a in left[need.any(1)]:
        own = gram[starts[a] : starts[a] + lens[a]]
        yield a, np.bincount(owners[flat_index(begin[own], count[own])], minlength=len(sets))


def _forest(pairs: list[tuple[int, int]], roots: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Of the pairs, in their order, those that connect what wasn't connected yet. roots: what is connected from the start."""
    up: dict[int, int] = dict(roots or {})

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up.setdefault(up[x], up[x])
            x = up[x]
        return x

    out = []
    for x, y in pairs:
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def components(edges: DataFrame) -> DataFrame:
    """v and root (the least id) of all ids that edges (a, b) hold, by alternating large and small stars."""
    edges, last = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "jaccard-edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()  # larger neighbours meet the least
        large = materialise(large, "jaccard-large")
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # all of b < a: smaller neighbours and the id itself meet the least
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "jaccard-small")
        discard(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        last = now


def _may_link(a: Column, b: Column, both: Column, percent: int) -> Column:
    """Whether sets of sizes a and b may link if they share no more than `both`."""
    return (100 + percent) * both >= percent * (a + b)


def _by_sketch(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size_a, size_b, sketch_a, sketch_b) those whose sketches allow a link, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())
                keep.append((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda x: sets.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class and set of all wanted classes, computed again. The texts are found by a map of bits over their hashes; a text that shares a bit with one is left out by its class."""
    h, word = F.col("_h"), F.pmod("_h", F.lit(64 * MAP_WORDS))
    bit = lambda w: F.expr(f"shiftleft(1L, cast({w} % 64 as int))")
    first = docs.where("class is not null").groupBy("class").agg(F.min("_h").alias("_h")).join(wanted, "class", "left_semi")
    marks = first.withColumn("w", word).groupBy(F.floor(F.col("w") / 64).alias("m")).agg(F.bit_or(bit("w")).alias("bits"))
    picked = rows.select(h, "_t").withColumn("w", word).withColumn("m", F.floor(F.col("w") / 64)).join(F.broadcast(marks), "m").where(F.col("bits").bitwiseAND(bit("w")) != 0).select("_h", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(n), set()
        for part, texts in chunks(batches, "_t"):
            new = []
            for x, t in zip(part.column(0).to_pylist(), texts, strict=True):
                if x not in met:
                    met.add(x)
                    new.append(t)
            found = [s for s in shingler.sets(new) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["class", "set"])

    return materialise(picked.mapInArrow(run, "class long, set binary").join(wanted, "class", "left_semi").groupBy("class").agg(F.first("set").alias("set")), "jaccard-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def _step(percent: int) -> float:
    """Buckets of sizes: logarithms, so wide that sizes which may match lie in one bucket or in neighbours."""
    return 1.001 * max(1e-3, math.log(100 / percent))


def _block_pairs(entries: DataFrame, percent: int, thin: bool) -> DataFrame:
    """Rows of entries (gram, class, size, bucket, root, ...) for each pair of blocks of their list that is compared: i <= j, own (the row's block). Blocks are parts of a bucket of sizes; buckets that aren't neighbours never match.

    thin: a block meets itself alone, so rows grow with the entries. Else all pairs of different roots meet: members of the list's most frequent root never meet
    each other, the others meet all, so rows grow with the entries unless many parts of a list are still apart."""
    if thin:
        entries = entries.withColumn("minor", F.lit(1))
    else:
        votes = entries.groupBy("gram", "root").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "root"))["root"].alias("major"))
        entries = entries.join(votes, "gram").withColumn("minor", (F.col("root") != F.col("major")).cast("int")).drop("major")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    counts = entries.groupBy("gram", "bucket").agg(blocks(F.sum("minor")).alias("few"), blocks(F.count("*") - F.sum("minor")).alias("many"), F.count("*").alias("n"))
    near = lambda d, x: counts.select("gram", (F.col("bucket") - d).alias("bucket"), F.col("few").alias(f"few_{x}"), F.col("many").alias(f"many_{x}"))
    counts = counts.join(near(1, "up"), ["gram", "bucket"], "left").join(near(-1, "down"), ["gram", "bucket"], "left").fillna(0)
    counts = counts.withColumns({"few_same": F.when(F.col("n") > 1, F.col("few")).otherwise(0), "many_same": F.col("many")}).where("few_same + few_up + few_down > 0")
    minor = F.col("minor") == 1
    rows = entries.join(counts, ["gram", "bucket"]).withColumn("part", F.pmod(F.xxhash64("class"), F.when(minor, F.col("few")).otherwise(F.col("many"))).cast("int"))
    block = lambda d, minor, part: (2 * (F.col("bucket") + d) + minor).cast("long") * 2**32 + part
    # the largest partner that what comes after the n-gram allows, and the least size of a bucket
    reach, least = F.floor((F.col("size") - F.col("at") + 1) * (100 + percent) / percent) - F.col("size"), lambda d: 0.999 * F.exp((F.col("bucket") + d) * F.lit(_step(percent)))
    none = F.array().cast("array<bigint>")

    def meets(name: str, d: int) -> Column:
        upto = lambda kind: F.when(F.col(f"{kind}_{name}") > 0, F.sequence(F.lit(0), F.col(f"{kind}_{name}") - 1)).otherwise(none.cast("array<int>"))
        to = lambda kind, minor: F.transform(upto(kind), lambda k: block(d, minor, k))
        return F.when(reach >= least(d), F.when(minor, F.concat(to("few", 1), to("many", 0))).otherwise(to("few", 1))).otherwise(none)

    rows = rows.withColumn("_own", block(0, F.col("minor"), F.col("part"))).withColumn("other", F.explode(F.when((F.col("few_same") > 0) & (reach >= least(0)), F.array("_own")).otherwise(none) if thin else F.concat(meets("same", 0), meets("up", 1), meets("down", -1))))
    rows = rows.withColumn("i", F.least("_own", "other")).withColumn("j", F.greatest("_own", "other")).withColumn("own", F.col("_own") == F.col("i"))
    return rows.select(*[c for c in entries.columns if c not in ("minor", "bucket")], "i", "j", "own")


def link(df: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: key, n_shingles, class (of equal sets), text_hash, component_id (the least key that links reach). Links: 100 * intersection >= percent * union."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t")).select("_k", "_h", "_t")
    kind = rows.schema["_k"].dataType.simpleString()
    docs = materialise(_prefixes(rows, n, percent, kind), "jaccard-docs")
    first = docs.where("inside is not null")
    # n-grams that stand more than once, by class, with their places
    grams = first.select("class", F.col("size").cast("int").alias("size"), F.size("inside").alias("held"), F.explode("inside").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(often, "gram").groupBy("class", "gram").agg(F.max("size").alias("size"), F.max("held").alias("held"), F.max("df").alias("df"))
    shared = shared.withColumn("at", F.row_number().over(W.partitionBy("class").orderBy("df", "gram")) + F.col("held") - F.count("*").over(W.partitionBy("class")))
    length = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    inside = shared.where(F.col("at") <= length).select("class", F.col("size").cast("long").alias("size"), F.col("at").cast("int").alias("at"), "gram")
    beyond = first.select("class", "size", F.size("inside").alias("held"), F.posexplode("beyond").alias("p", "gram")).select("class", "size", (F.col("p") + F.col("held") + 1).alias("at"), "gram")
    prefix = inside.unionByName(beyond).groupBy("class").agg(F.max("size").alias("size"), F.sort_array(F.collect_set(F.struct("at", "gram"))).alias("prefix"))
    members = materialise(prefix.withColumn("group", F.xxhash64("size", "prefix")), "jaccard-members")
    groups = members.groupBy("group").agg(F.first("size").alias("size"), F.count("*").alias("n"), F.min(F.struct("class", "prefix"))["prefix"].alias("prefix"))
    lists = materialise(groups.select("group", "size", "n", F.explode("prefix").alias("x")).select("group", "size", "n", "x.at", "x.gram"), "jaccard-lists")
    sizes = lists.groupBy("gram").agg(F.sum("n").alias("members")).where("members > 1")
    light, heavy = sizes.where(F.col("members") <= LIGHT).select("gram"), sizes.where(F.col("members") > LIGHT).select("gram")
    # pairs of groups whose sizes and places allow a link, then of their members
    a, b = (lists.join(light, "gram").select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("group", "size", "n", "at")]) for x in "ab")
    alike = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1
    fit = (F.col("group_a") < F.col("group_b")) | ((F.col("group_a") == F.col("group_b")) & (F.col("n_a") > 1))
    pairs = a.join(b, "gram").where(fit & alike & _may_link(F.col("size_a"), F.col("size_b"), rest, percent)).select("group_a", "group_b").distinct()
    of = lambda x: members.select(F.col("group").alias(f"group_{x}"), F.col("class").alias(x))
    pairs = pairs.join(of("a"), "group_a").join(of("b"), "group_b").where((F.col("group_a") < F.col("group_b")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # long lists
    entries = members.select("class", "size", F.explode("prefix").alias("x")).select("class", "size", F.col("x.at").alias("at"), F.col("x.gram").alias("gram")).join(heavy, "gram")
    entries = materialise(entries.withColumn("bucket", F.floor(F.log(F.col("size").cast("double")) / _step(percent)).cast("int")), "jaccard-heavy")
    sketches = first.groupBy("class").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sketches = materialise(sketches.join(members.select("class"), "class", "left_semi"), "jaccard-sketches")
    with_sketch = lambda x: sketches.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    pairs = pairs.join(with_sketch("a"), "a").join(with_sketch("b"), "b")

    def candidates(pdf: pd.DataFrame, thin: bool) -> pd.DataFrame:
        gram, i, j = (int(pdf[c].iloc[0]) for c in ("gram", "i", "j"))
        same, ours = i == j, pdf["own"].to_numpy(bool)
        name, size, after, root = pdf["class"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), (pdf["size"] - pdf["at"] + 1).to_numpy(np.int64), pdf["root"].to_numpy(np.int64)
        left, right = (np.arange(len(name)), np.arange(len(name))) if same else (np.flatnonzero(ours), np.flatnonzero(~ours))
        width = min(map(len, pdf["sketch"]))
        bits = np.array([_folded(s, width) for s in pdf["sketch"]])
        found, far = [], []
        for x in left:
            need = (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])) & (root[right] != root[x])
            need &= (100 + percent) * np.minimum(after[right], after[x]) >= percent * (size[right] + size[x])
            if same:
                need &= name[right] > name[x]
            at = right[need]
            if len(at):
                both = size[at] + size[x]
                apart = np.bitwise_count(bits[at] ^ bits[x]).sum(1, dtype=np.int64)
                may = (100 + percent) * (both - apart) >= 2 * percent * both
                if may.any():
                    found.append(np.stack([np.full(int(may.sum()), x), at[may]]))
                    far.append(apart[may] / both[may])
        if not found:
            return pd.DataFrame({"a": [], "b": [], "block": []}).astype({"a": "int64", "b": "int64", "block": "object"})
        got = np.concatenate(found, 1)
        if thin:
            order = np.argsort(np.concatenate(far), kind="stable")
            got = np.array(_forest(list(zip(*got[:, order].tolist(), strict=True)))).T
        if got.shape[1] <= DENSE * len(name):
            ends = np.sort(name[got], 0)
            return pd.DataFrame({"a": ends[0], "b": ends[1], "block": None})
        met = np.unique(got)  # members alone: their pairs are many
        return pd.DataFrame({"a": name[met], "b": ours[met].astype(np.int64) + 2 * same, "block": f"{gram} {i} {j}"})

    def by_blocks(roots: DataFrame | None) -> DataFrame:
        """What blocks of long lists leave to verify, without roots a forest of it."""
        thin = roots is None
        if thin:
            rooted = entries.withColumn("root", F.col("class"))
        else:
            rooted = entries.join(roots.select(F.col("v").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        blocks = _block_pairs(rooted, percent, thin).join(sketches.select("class", "sketch"), "class").select("gram", "i", "j", "own", "class", "size", "at", "root", "sketch")
        return materialise(blocks.groupBy("gram", "i", "j").applyInPandas(lambda pdf: candidates(pdf, thin), "a long, b long, block string"), "jaccard-blocks")

    thin = by_blocks(None)
    listed = materialise(_by_sketch(pairs, percent).unionByName(thin.select("a", "b")).distinct(), "jaccard-pairs")
    discard(thin)
    first_sets = _sets(rows, docs, _ends(listed), n)
    links = materialise(_verified(listed, first_sets, percent), "jaccard-links")
    roots = components(links)
    left_over = by_blocks(roots)
    pairs = left_over.where("block is null").select("a", "b").distinct()
    dense = left_over.where("block is not null").select(F.col("a").alias("class"), F.col("b").alias("side"), "block")
    sets = _sets(rows, docs, _ends(pairs).unionByName(dense.select("class")).distinct(), n)

    def compare_block(pdf: pd.DataFrame) -> pd.DataFrame:
        name, held, side, root = pdf["class"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in pdf["set"]], pdf["side"].to_numpy(np.int64), pdf["root"].to_numpy(np.int64)
        size = np.array([len(s) for s in held])
        same = side[0] >= 2
        left, right = (np.arange(len(name)), np.arange(len(name))) if same else (np.flatnonzero(side == 1), np.flatnonzero(side == 0))
        need = (100 * np.minimum(size[left][:, None], size[right]) >= percent * np.maximum(size[left][:, None], size[right])) & (root[left][:, None] != root[right])
        if same:
            need &= name[left][:, None] < name[right]
        links, at = [], {x: k for k, x in enumerate(left.tolist())}
        for x, both in _overlaps(held, left, need) if need.any() else ():
            both = both[right]
            for y in right[need[at[x]] & (100 * both >= percent * (size[x] + size[right] - both))]:
                links.append((int(name[x]), int(name[y])))
        return pd.DataFrame(_forest(links), columns=["a", "b"], dtype="int64")

    many = dense.join(roots.select(F.col("v").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")).join(sets, "class").groupBy("block").applyInPandas(compare_block, "a long, b long")
    more = materialise(_verified(pairs, sets, percent).unionByName(many), "jaccard-more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    names = docs.where("class is not null").groupBy("class").agg(F.min("_k").alias("first"))
    labels = names.join(roots.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    labels = materialise(labels, "jaccard-labels")
    least = labels.groupBy("root").agg(F.min("first").alias("component"))
    labels = labels.join(least, "root").select("class", "root", "component")
    ids = materialise(docs.select("_k", "_h", "class", "size"), "jaccard-ids")
    discard(docs, members, lists, entries, sketches, listed, links, left_over, first_sets, sets, more)
    out = ids.join(labels, "class", "left")
    return out.select(F.col("_k").alias(key), F.col("size").alias("n_shingles"), F.col("class"), F.col("_h").alias("text_hash"), F.col("root").alias("root"), F.coalesce("component", "_k").alias("component_id"))
