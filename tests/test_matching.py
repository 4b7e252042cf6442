"""Names in steps and staged rows against loops."""

import random

from pyspark.sql import functions as F

from prosemill.operators import matching


def cascade(want, names):
    """names: (order, name); the first match of the first step that has any."""
    w = (want or "").strip().lower()
    if not w:
        return None, None
    held = sorted((o, n) for o, n in names if n and n.strip())
    rules = [lambda a: a == w, lambda a: w in a or a in w, lambda a: w.split()[-1] in a.split()]
    for step, rule in enumerate(rules, 1):
        for _, n in held:
            if rule(n.strip().lower()):
                return step, n
    return None, None


def test_steps_are_those_of_the_loop(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    names = [(i, " ".join(word() for _ in range(rng.randint(1, 3)))) for i in range(60)] + [(100, None), (101, " "), (102, "Shake Speare"), (103, "shake speare "), (104, "X"), (105, "yz"), (106, "Tim Hotly")]
    wants = [n.upper() if n else None for _, n in names[:20]] + [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(80)] + [None, "", " ", "William Speare", "speare", "the x men", "z", "qqqq", "speare", "SHAKE speare", "Jimmy Hotly"]
    got = matching.match_names(spark.createDataFrame(list(enumerate(wants)), "i int, want string"), spark.createDataFrame(names, "o int, name string"), "want", "name", "o").orderBy("i").collect()
    assert [(r.step, r.found) for r in got] == [cascade(w, names) for w in wants]
    assert {r.step for r in got} == {1, 2, 3, None}


def test_stages_are_those_of_the_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice("pqrstuv"), rng.randint(0, 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, k string, t string, n int").repartition(5)
    stages = [("short", "drop", F.col("n") < 3), ("same_k_t", "first", F.concat("k", "t")), ("same_t", "first", F.when(F.col("n") > 10, F.col("t")))]
    seen1, seen2, want = set(), set(), {}
    for o, k, t, n in rows:
        if n < 3:
            want[o] = "short"
            continue
        if k is not None and (k, t) in seen1:
            want[o] = "same_k_t"
            continue
        seen1.add((k, t))
        if n > 10 and t in seen2:
            want[o] = "same_t"
            continue
        if n > 10:
            seen2.add(t)
        want[o] = None
    out = matching.staged(df, "o", stages)
    assert {r.o: r.skipped for r in out.collect()} == want
    got = {r.stage: (r.seen, r.skipped) for r in matching.accounts(out, [s for s, _, _ in stages]).collect()}
    counts = [sum(v == s for v in want.values()) for s in ("short", "same_k_t", "same_t")]
    assert got == {"short": (200, counts[0]), "same_k_t": (200 - counts[0], counts[1]), "same_t": (200 - counts[0] - counts[1], counts[2]), "kept": (200 - sum(counts), 0)}
    assert matching.staged(df.limit(0), "o", stages).count() == 0
