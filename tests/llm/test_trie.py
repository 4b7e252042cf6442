"""The conversation trie against plain dictionaries, split and unsplit."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prosemill.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Rows of the contract from (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {c: tuple(own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:]) for c, v in own.items()}
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    kids = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    tokens = {p: len(WORD.findall(p[-1][1])) if p else 0 for p in members}
    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if full[c] == p)
        saved = sum((len(members[q]) - 1) * tokens[q] for q in below[p])
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), sum(not kids[q] for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    """Conversations with shared prefixes, copies, nulls and long ones."""
    rng, rows = random.Random(seed), []
    seen = []
    for c in range(0, 3 * n, 3):
        base = rng.choice(seen) if seen and rng.random() < 0.7 else []
        turns = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\nf", "é g"])) for _ in range(rng.randint(0, 5))]
        turns = turns or [(None, None)]
        seen.append(turns)
        rows += [(c, None if i == 0 and rng.random() < 0.5 else i, *t) for i, t in enumerate(turns)]
    rows += [(5000 + k, i, "user", f"long {i % 7}") for k in (0, 1, 7) for i in range(60 + k)]
    rows += [(7000 + k, i, "system", f"same {i}") for k in range(12) for i in range(9)]
    return rows + [(None, 1, "user", "left out"), (8001, 0, "user", "gone")]


@pytest.mark.parametrize("most", [100_000, 25, 3])
def test_nodes_split_or_not(spark, most):
    rows = made(most, 40)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    df = df.withColumns({"conv": F.lit(1), "place": F.lit(2), "digest": F.lit(3), "_row": F.lit(4), "grp": F.lit(5)})
    assert sorted((tuple(r) for r in trie.by_twenties(df, most).collect()), key=repr) == brute(rows)


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted((tuple(r) for r in trie.by_twenties(df).collect()), key=repr) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table_repeats_and_lone_root(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert trie.by_twenties(spark.createDataFrame([], kind)).count() == 0 == trie.by_twenties(spark.createDataFrame([(None, 1, "a", "b")], kind)).count()
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    root = trie.by_twenties(spark.createDataFrame([(lone, 1, "user", "a")], kind)).collect()
    assert [tuple(r) for r in root] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    twice = trie.nodes(trie.turns(spark.createDataFrame([(20, 1, "user", "a b")] * 3 + [(40, 1, "user", "a b")], kind))).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in twice] == [(0, 2, 1, 1, 2), (1, 2, 1, 1, 2), (2, 1, 1, 1, 0), (3, 1, 0, 1, 0)]
