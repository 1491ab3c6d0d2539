"""Pointer doubling, components, ordered folds and ordered changes against plain loops."""

import random

from pyspark.sql import functions as F

from tracelake.operators import changes as ch
from tracelake.operators import graphs, skew


def plain_end(step, start):
    path = [start]
    while step.get(path[-1]) is not None and step[path[-1]] not in path:
        path.append(step[path[-1]])
    return path[-1]


def test_followed_agrees_with_walking(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        names = [f"n{i}" for i in range(rng.randint(1, 40))]
        step = {a: rng.choice([*names, "out"]) for a in names if rng.random() < 0.9}
        rows += [(k, a, b) for a, b in step.items()]
        want |= {(k, a): plain_end(step, a) for a in step}
    got = graphs.followed(spark.createDataFrame(rows, "k int, a string, b string"), ["k"], "a", "b").collect()
    assert len(got) == len(want) and {(r.k, r.a): r.end for r in got} == want
    none = graphs.followed(spark.createDataFrame([], "k int, a string, b string"), ["k"], "a", "b")
    assert none.count() == 0


def test_a_chain_of_five_thousand_takes_thirteen_rounds(spark, monkeypatch):
    rounds, staged = [], graphs.stage
    monkeypatch.setattr(graphs, "stage", lambda df, label: rounds.append(label) or staged(df, label))
    chain = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graphs.followed(chain, ["k"], "a", "b")
    assert got.agg(F.count("*"), F.min("end"), F.max("end")).first() == (5000, 5000, 5000)
    assert rounds.count("followed") <= 13


def plain_groups(edges):
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for p, q in edges:
                if p == todo[0] and q not in seen:
                    seen.add(q)
                    todo.append(q)
            todo.pop(0)
        reach[a] = seen
    return {frozenset(b for b in reach if b == a or b in reach[a] and a in reach[b]) for a in reach if a in reach[a]}


def test_components_agree_with_reachability(spark):
    rng = random.Random(9)
    for edges_each in (8, 20, 40):
        every = {k: {(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}") for _ in range(edges_each)} for k in "ab"}
        every["c"] = {("x", "x"), ("x", "y"), ("y", "x"), ("z", "z"), ("p", "q"), ("q", "r")}
        rows = [(k, a, b) for k, edges in every.items() for a, b in edges] + [("c", None, "p"), ("c", "p", None)]
        got = {}
        for r in graphs.cyclic_groups(spark.createDataFrame(rows, "k string, a string, b string"), ["k"], "a", "b").collect():
            got.setdefault((r.k, r.component), set()).add(r.name)
        for k, edges in every.items():
            assert {frozenset(v) for (j, _), v in got.items() if j == k} == plain_groups(edges)


def test_folds_keep_the_order_whatever_the_runs(spark, monkeypatch):
    monkeypatch.setattr(skew, "FOLD", 7)
    rows = [("hot", i, f"{i},") for i in range(400)] + [("cold", 5, "x"), ("cold", -5, "y"), (None, 1, "z")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(5)
    got = {r.k: r.v for r in skew.fold_in_order(df, ["k"], "at", "v", F.lit(""), lambda x, y: F.concat(x, y)).collect()}
    assert got == {"hot": "".join(f"{i}," for i in range(400)), "cold": "yx", None: "z"}


def plain_notes(old, changes):
    tags, comment = list(old[0]), old[1]
    for c in sorted(changes, key=lambda c: c["ord"]):
        base = list(c["set_tags"]) if c["set_tags"] is not None else tags
        tags = [t for t in dict.fromkeys([*base, *(c["add_tags"] or [])]) if t not in (c["remove_tags"] or [])]
        said = c["set_comment"] if c["set_comment"] is not None else comment
        comment = "\n".join(x for x in (said, c["append_comment"]) if x)
    return tags, comment


def test_ordered_changes_are_all_applied_or_reported(spark, monkeypatch):
    monkeypatch.setattr(skew, "FOLD", 5)
    rng = random.Random(6)
    some = lambda: rng.choice([None, [], *[[rng.choice("pqrst") for _ in range(rng.randint(1, 3))] for _ in range(3)]])
    olds = {f"f{i}": (list(dict.fromkeys(rng.choices("pqrst", k=2))), rng.choice(["", "old"])) for i in range(12)}
    changes = []
    for name in [*olds, "new", "many"]:
        for n in range(60 if name == "many" else rng.randint(0, 4)):
            changes.append({"archive": "A", "run_id": "S", "filename": name, "ord": n * 3, "add_tags": some(), "remove_tags": some(), "set_tags": rng.choice([None, None, some()]),
                            "append_comment": rng.choice([None, "", f"line {n}"]), "set_comment": rng.choice([None, None, None, "", f"set {n}"])})
    schema = ("archive string, run_id string, filename string, ord int, add_tags array<string>, remove_tags array<string>, set_tags array<string>, "
              "append_comment string, set_comment string")
    bad = {**changes[0], "filename": "f1", "ord": 1, "add_tags": ["a,b"]}
    tied = [{**changes[0], "filename": "f2", "ord": 1, "add_tags": [t], "set_comment": None} for t in "xy"]
    asked = spark.createDataFrame([[c[f.split()[0]] for f in schema.split(", ")] for c in [*changes, bad, *tied]], schema)
    table = spark.createDataFrame([("A", "S", n, t, c) for n, (t, c) in olds.items()], "archive string, run_id string, filename string, tags array<string>, comment string")
    out, refused = ch.annotate(table, asked)
    want = {n: plain_notes(olds.get(n, ([], "")), [c for c in changes if c["filename"] == n]) for n in {*olds, *(c["filename"] for c in changes)}}
    assert {r.filename: (r.tags, r.comment) for r in out.collect()} == {n: v for n, v in want.items() if v[0] or v[1]}
    assert sorted((r.filename, r.refused) for r in refused.collect()) == [("f1", "unusable tag: a,b"), ("f2", "changed twice"), ("f2", "changed twice")]
    first = [c for c in changes if c["ord"] == 0]
    alone, refused = ch.annotate(table, spark.createDataFrame([[c[f.split()[0]] for f in schema.split(", ")] for c in first], schema).drop("ord"))
    assert refused.count() == 0 and {r.filename: r.tags for r in alone.collect() if r.filename == "many"} == (
        {"many": plain_notes(([], ""), [c for c in first if c["filename"] == "many"])[0]} if plain_notes(([], ""), [c for c in first if c["filename"] == "many"])[0] or plain_notes(([], ""), [c for c in first if c["filename"] == "many"])[1] else {})
