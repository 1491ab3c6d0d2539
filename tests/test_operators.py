"""Operators on small hand-built tables, against brute force where it pays."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.refs import parse_refs
from tracelake.operators import items as it
from tracelake.operators import lineage as li
from tracelake.operators import search as se
from tracelake.operators import skew, store, transfer as tr
from tracelake.operators import refresh as rf

EDGE = """archive string, run_id string, filename string, ord int, ref_user string, ref_archive string, ref_session string,
  ref_file string, ref_collection string, ref_asset string, ref_sha256 string, ref_fidelity string"""


def edges(spark, *rows):
    full = [(a, r, f, 0, None, ra, rs, rf_, None, asset, None, None) for a, r, f, ra, rs, rf_, asset in rows]
    return spark.createDataFrame(full, EDGE)


def archives(spark):
    return spark.createDataFrame([("A", True), ("B", True), ("C", False)], "archive string, reachable boolean")


def test_upstream_crosses_archives_and_stops_at_unreachable(spark):
    e = edges(spark, ("A", "S3", "fit.png", None, "S2", "proc.csv", None), ("A", "S2", "proc.csv", "B", "S1", "raw.csv", None),
              ("B", "S1", "raw.csv", "C", "S0", "cal.csv", None), ("C", "S0", "cal.csv", None, None, "x.csv", None),
              ("A", "S3", "fit.png", None, None, "figure.svg", "AF-26-0001"))
    seeds = spark.createDataFrame([("A", "S3", "fit.png")], "archive string, run_id string, filename string")
    got = {(r.archive, r.run_id, r.filename, r.depth, r.unresolved) for r in li.upstream(seeds, e, archives(spark)).collect()}
    assert got == {("A", "S2", "proc.csv", 1, False), ("B", "S1", "raw.csv", 2, False), ("C", "S0", "cal.csv", 3, True)}


def test_cycles_end_and_same_id_in_two_archives_stays_apart(spark):
    e = edges(spark, ("A", "S1", "a", None, None, "b", None), ("A", "S1", "b", None, None, "a", None),
              ("B", "S1", "a", None, None, "z", None))
    seeds = spark.createDataFrame([("A", "S1", "a")], "archive string, run_id string, filename string")
    got = {(r.archive, r.filename) for r in li.upstream(seeds, e, archives(spark)).collect()}
    assert got == {("A", "b")}
    down = li.downstream(spark.createDataFrame([("B", "S1", "z")], seeds.schema), e).collect()
    assert [(r.archive, r.filename) for r in down] == [("B", "a")]


def test_tree_marks_diamond_and_depth(spark):
    e = edges(spark, *[("A", "S", c, None, None, p, None) for c, p in (("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "z"))])
    roots = spark.createDataFrame([("A", "S", "d")], "archive string, run_id string, filename string")
    files = spark.createDataFrame([("A", "S", "a"), ("A", "S", "b")], "archive string, run_id string, name string")
    rows = li.provenance_tree(roots, e, files, archives(spark), "up", 2).collect()
    got = sorted((r.from_filename, r.filename, r.depth, r.seen, r.truncated, r.exists) for r in rows)
    assert got == [("b", "a", 2, False, True, True), ("c", "a", 2, True, False, True),
                   ("d", "b", 1, False, False, True), ("d", "c", 1, False, False, False)]


def test_rename_log_follows_chains_and_stops_on_cycles(spark):
    log = spark.createDataFrame([("A", "S", 1, "a", "b"), ("A", "S", 2, "b", "c"), ("A", "S", 3, "x", "y"),
                                 ("A", "S", 4, "y", "x"), ("A", "S", 5, "a", "q")],
                                "archive string, run_id string, ord int, old_name string, new_name string")
    got = {r.old_name: r.current_name for r in li.current_names(log).collect()}
    assert got == {"a": "q", "b": "c", "x": "y", "y": "x"}


def test_two_level_group_functions_agree_with_plain_loops(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(40), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    args = (["k"], F.floor(F.col("t") / 10))
    ranked = {r.i: r.n for r in skew.rank_in_groups(df, *args, [F.col("t"), F.col("i")], "n").collect()}
    summed = {r.i: r.s for r in skew.running_sum(df, *args, [F.col("t"), F.col("i")], F.col("v"), "s").collect()}
    before = {r.i: r.b for r in skew.previous_in_groups(df, *args, ["t", "i"], "v", "b").collect()}
    for k in "ab":
        total, last = 0, None
        for n, (_, t, i, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            total += v
            assert (ranked[i], summed[i], before[i]) == (n, total, last)
            last = v


def test_hot_keys_are_split_without_losing_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), ("odd", 2)], "k string, i int")
    per = df.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.attach(df, per, ["k"], "n", ["i"], "inner").groupBy("k", "n").count().collect()
    assert {(r["k"], r["n"], r["count"]) for r in got} == {("hot", 300, 300), ("cold", 1, 1), ("odd", 1, 1)}


def test_lines_of_heavy_and_light_keys_are_numbered_alike(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choice("ab"), rng.randrange(9), i) for i in range(400)]
    nameless = [(1, None, 3, 900), (2, None, 4, 901), (1, "a", None, 902), (2, "b", None, 903)]
    lines = spark.createDataFrame(rows + nameless, "l_key int, name string, day int, n int")
    owners = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (3, "z"), (5, "y")], "key int, owner string")

    def build(some):
        return some.join(owners, some.l_key == owners.key).select("key", "owner", "name", "day", "n")

    owned = [(k, o, name, -1 if day is None else day, n) for k, name, day, n in rows + nameless if name for key, o in ((1, "x"), (2, "x"), (3, "y"), (3, "z")) if k == key]
    want = {(k, o, n): sum((d2, n2) <= (day, n) for k2, o2, name2, d2, n2 in owned if (k2, o2, name2) == (k, o, name))
            for k, o, name, day, n in owned if day >= 0}
    for limit in (10**6, 100, 1):
        monkeypatch.setattr(skew, "HOT_ROWS", limit)
        got = skew.rank_by_key(lines, "l_key", build, "key", ["owner", "name"], F.col("day"), [F.col("day"), F.col("n")], "pos").collect()
        assert len(got) == len(want) and {(r.key, r.owner, r.n): r.pos for r in got} == want


def test_lines_are_ranked_without_a_shuffle_of_their_own(spark):
    lines = spark.range(1000).select((F.col("id") % 50).alias("l_key"), "id")
    owners = spark.range(50).select(F.col("id").alias("key"), F.lit("x").alias("owner"))

    def build(some):
        return some.join(owners.hint("merge"), some.l_key == owners.key).select("key", "owner", "id")

    ranked = skew.rank_by_key(lines, "l_key", build, "key", ["owner"], F.col("id"), [F.col("id")], "pos")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" in plan


def test_names_skip_numbers_in_use(spark):
    key = "archive string, run_id string, requested string, at string"
    asked = spark.createDataFrame([("A", "S", "raw.csv", str(i)) for i in range(4)] + [("A", "S", "raw-004.csv", "9")], key)
    there = spark.createDataFrame([("A", "S", "raw.csv"), ("A", "S", "raw-002.csv")], "archive string, run_id string, name string")
    got = tr.resolve_names(asked, there, ["at"], F.col("at")).orderBy("at").collect()
    assert [r.filename for r in got] == ["raw-001.csv", "raw-003.csv", "raw-005.csv", "raw-006.csv", "raw-004.csv"]
    got = tr.resolve_names(asked, there, ["at"], F.col("at"), "cancel").orderBy("at").collect()
    assert [r.filename for r in got] == [None] * 4 + ["raw-004.csv"]


def test_byte_cap_keeps_newest_and_counts_evicted(spark):
    snaps = spark.createDataFrame([("A", "x", i, f"2024-01-0{i}", b, False) for i, b in ((1, 10), (2, 90), (3, 5), (4, 300))],
                                  "archive string, asset_id string, ord int, at_day string, bytes bigint, pending_gc boolean")
    caps = spark.createDataFrame([("A", "x", 0, 310)], "archive string, asset_id string, cap_count int, cap_bytes bigint")
    assert {r.ord: r.evict for r in store.snapshot_caps(snaps, caps).collect()} == {4: False, 3: False, 2: True, 1: True}
    caps = spark.createDataFrame([("A", "x", 1, 10)], caps.schema)
    assert {r.ord: r.evict for r in store.snapshot_caps(snaps, caps).collect()} == {4: False, 3: True, 2: True, 1: True}


def test_search_grammar():
    got = [(c.field, c.quote, c.text) for c in se.clauses_of("tag:'a b' file:\"x\\\"y\" http://z 'open TAG: w")]
    assert got == [("tags", "'", "a b"), ("filename", '"', 'x"y'), (None, None, "http://z"), (None, "'", "open TAG: w")]
    assert se.clauses_of("  ") == [] and se.asks_nothing("", None, None, ["script", "external", "unrecorded"])
    assert not se.asks_nothing("", None, None, ["external"])


def test_repairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abc1") for _ in range(rng.randrange(5, 9))) for _ in range(60)})
    wanted = ["".join(rng.choice("abc1") for _ in range(7)) for _ in range(15)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    broken = spark.createDataFrame([("A", w) for w in wanted], "archive string, w string")
    have = spark.createDataFrame([("A", k) for k in known], "archive string, c string")
    want = set()
    for w in wanted:
        scored = [(-(1 - distance(w, k) / max(len(w), len(k))), k) for k in known]
        want |= {(w, k) for s, k in sorted(scored)[:3] if -s >= 0.6}
    for few in (1000, 1):
        monkeypatch.setattr(tr, "FEW", few)
        got = {(r.w, r.c) for r in tr.closest(broken, have, ["archive"], "w", "c").collect()}
        assert got == want
    exact = {(r.w, r.c) for r in tr.closest_by_matching(broken, have, ["archive"], "w", "c").collect()}
    assert exact == {(w, k) for w in wanted for k in difflib.get_close_matches(w, known, 3, 0.6)}


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_variants_meet_for_near_texts_only(spark):
    rng = random.Random(11)
    texts = lambda n: sorted({"".join(rng.choice("aab") for _ in range(rng.randrange(0, 7))) for _ in range(n)})
    asked, known = texts(40), texts(40) + ["bbbbbbbbbbb"]
    left = spark.createDataFrame([(t,) for t in asked] + [(None,)], "wanted string")
    right = spark.createDataFrame([(t,) for t in known] + [(None,)], "candidate string")
    for k in (1, 2, 3):
        a = tr._variants(left, "wanted", k, tr._lengths(right, "candidate")).withColumnRenamed("_edits", "_gone")
        b = tr._variants(right, "candidate", k, tr._lengths(left, "wanted")).drop("_marks")
        met = a.join(b, "_variant").where(F.col("_gone") + F.col("_edits") + F.col("_marks") <= k)
        got = {(r.wanted, r.candidate) for r in met.select("wanted", "candidate").distinct().collect()}
        assert got == {(x, y) for x in asked for y in known if _edit_distance(x, y) <= k}


def test_variants_of_names_are_never_sent_whole_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(tr, "FEW", 5)
    plans, keep = [], tr.stage
    monkeypatch.setattr(tr, "stage", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    names = spark.range(300).select(F.lit("A").alias("archive"), F.format_string("name-%05d", "id").alias("candidate"))
    asked = spark.range(300).select(F.lit("A").alias("archive"), F.format_string("nome-%05d", "id").alias("wanted"))
    best = {r.wanted: r.candidate for r in tr.closest(asked, names, ["archive"], "wanted", "candidate").where("place = 1").collect()}
    assert best == {f"nome-{i:05d}": f"name-{i:05d}" for i in range(300)}
    near = [plan for label, plan in plans if label.startswith("near-")]
    assert len(near) == 3 and not any("_variant" in line and "BroadcastHashJoin" in line for plan in near for line in plan.split("\n"))


def test_letters_find_the_nearest_among_many(spark):
    """Most of the names of an archive are alike; few of them are ever compared."""
    rng = random.Random(11)
    known = sorted({f"S-24-{rng.randrange(10 ** 6):06}" for _ in range(500)} | {"".join(rng.choice("abcde-") for _ in range(rng.randrange(1, 14))) for _ in range(200)})
    wanted = [f"S-42-{rng.randrange(10 ** 6):06}" for _ in range(6)] + ["abcab-d", "eeeee", "x", "", "S24", "a-b-c-d-e-a", "zzzzzzzz"]
    broken = spark.createDataFrame([("A", w) for w in wanted] + [("B", wanted[0])], "archive string, w string")
    have = spark.createDataFrame([("A", k) for k in known], "archive string, c string")
    got = {(r.w, r.c) for r in tr.closest_by_matching(broken, have, ["archive"], "w", "c").where("archive = 'A'").collect()}
    assert got == {(w, k) for w in wanted for k in difflib.get_close_matches(w, known, 3, 0.6)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    found = tr.nearest_by_letters(broken, have, ["archive"], "w", "c", tr.EDITS).where("archive = 'A'").collect()
    assert len(found) < len(wanted) * len(known) / 4
    near = {}
    for r in found:
        near.setdefault(r.w, []).append((-r.score, r.c))
    for w in filter(None, wanted):
        want = sorted((-(1 - distance(w, k) / max(len(w), len(k))), k) for k in known)
        assert sorted(near.get(w, []))[:3] == [(s, k) for s, k in want[:3] if -s >= 0.6]


def test_diff_of_a_catalog_with_itself_is_empty_and_order_does_not_count(spark):
    rows = [("A", 2024, "S1", "session.yaml", 10, "t"), ("A", 2024, "S1", "a.meta.json", 5, "u"), ("A", 2024, "S1", "a.csv", 9, "v")]
    schema = "archive string, year int, run_id string, name string, size bigint, mtime string"
    one = rf.session_signatures(spark.createDataFrame(rows, schema))
    two = rf.session_signatures(spark.createDataFrame(rows[::-1][1:], schema))
    changes = rf.diff(one, two, ["archive", "year", "run_id"]).collect()
    assert [c.change for c in changes] == ["unchanged"]


def test_item_order_keeps_undated_last(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "2024-01-01T00:00:00+00:00"), ("b", 1, "2024-01-01T01:00:00+01:00"),
                                ("c", 1, "2024-01-02T00:00:00+00:00")], "display_name string, position int, timestamp string")
    assert [(r.display_name, r.position) for r in df.orderBy(*it.item_order()).collect()] == [("c", 1), ("b", 1), ("b", 2), ("a", 1)]


CHAIN = 61


def test_walks_have_no_hidden_depth(spark):
    rows = [("A", "S", i, f"n{i}", f"n{i + 1}") for i in range(CHAIN)]
    log = spark.createDataFrame(rows, "archive string, run_id string, ord int, old_name string, new_name string")
    got = {r.old_name: r.current_name for r in li.current_names(log).collect()}
    assert got == {f"n{i}": f"n{CHAIN}" for i in range(CHAIN)}

    links = spark.createDataFrame([("A", f"c{i:02}", f"c{i + 1:02}") for i in range(CHAIN)], "archive string, parent string, child string")
    names = spark.createDataFrame([("A", f"c{i:02}") for i in range(CHAIN + 1)], "archive string, collection string")
    assert [tuple(r) for r in li.hierarchy_roots(links, names).collect()] == [("A", "c00", False)]
    ends = spark.createDataFrame([("A", f"c{CHAIN:02}", "c00")], links.schema)
    reach = li.collections_reached(links.unionByName(ends)).where("start = target").count()
    assert reach == CHAIN + 1, "a cycle longer than any fixed depth is met"


def test_a_limited_walk_says_where_it_stopped(spark):
    links = spark.createDataFrame([("s", f"{i}", f"{i + 1}") for i in range(5)] + [("s", "1", "x")], "k string, a string, b string")
    seeds = spark.createDataFrame([("s", "0")], "seed string, n string")
    got = li.walk(seeds, links, ["seed"], ["n"], ["a"], ["b"], max_depth=2)
    assert sorted((r.n, r.depth, r.truncated) for r in got.collect()) == [("1", 1, False), ("2", 2, True), ("x", 2, False)]


def test_two_changes_of_one_target_never_double_it(spark):
    from tracelake.operators import changes as ch

    sessions = spark.createDataFrame([("A", "S", None), ("A", "T", None)], "archive string, run_id string, hold_until string")
    holds = [("A", "S", False, 60, 1), ("A", "S", True, None, 2), ("A", "T", False, None, 1)]
    schema = "archive string, run_id string, release boolean, seconds int, ord int"
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    out, refused = ch.hold_sessions(sessions, spark.createDataFrame(holds, schema), now)
    assert {r.run_id: r.hold_until is None for r in out.collect()} == {"S": True, "T": False} and out.count() == 2
    assert refused.count() == 0
    out, refused = ch.hold_sessions(sessions, spark.createDataFrame(holds, schema).drop("ord"), now)
    assert out.count() == 2 and [r.refused for r in refused.collect()] == ["changed twice"] * 2


def test_a_name_of_full_length_gets_a_free_one(spark):
    long = "x" * 120
    new = spark.createDataFrame([(long,)], "collection string")
    got = tr.carry_collections(new, spark.createDataFrame([(long,), ("x" * 113 + "-intake",)], "collection string"), "intake").collect()
    assert [r.new_name for r in got] == ["x" * 111 + "-intake-2"]


def test_a_source_name_of_any_length_leaves_room_for_the_number(spark):
    new = spark.createDataFrame([("set",)], "collection string")
    taken = [("set",), ("s-" + "q" * 118,), ("s-" + "q" * 116 + "-2",)]
    got = tr.carry_collections(new, spark.createDataFrame(taken, "collection string"), "q" * 130).collect()
    assert [r.new_name for r in got] == ["s-" + "q" * 116 + "-3"]


def test_entries_move_between_collections(spark):
    from tracelake.operators import changes as ch

    entries = spark.createDataFrame([("A", "one", 0, "S-24-0001/a.csv", "kept note"), ("A", "one", 1, "collections/two", ""), ("A", "two", 4, "S-24-0002", "")],
                                    "archive string, collection string, ord int, ref string, note string")
    moves = spark.createDataFrame([("A", "one", "two", "S-24-0001/a.csv"), ("A", "one", "two", "collections/two"), ("A", "two", "two", "S-24-0002")],
                                  "archive string, collection string, target string, ref string")
    after, refused = ch.move_entries(entries, moves)
    assert sorted((r.collection, r.ord, r.ref, r.note) for r in after.collect()) == [
        ("one", 1, "collections/two", ""), ("two", 4, "S-24-0002", ""), ("two", 5, "S-24-0001/a.csv", "kept note")]
    assert [r.refused for r in refused.collect()] == ["contains itself"]


def test_whole_merge_holds_back_sealed_years(spark):
    entry = "struct<action:string, at:string, by:string, file:string, note:string>"
    sessions = spark.createDataFrame(
        [("IN", "I-99-0001", "1999", "closed", []), ("IN", "I-98-0001", "1998", "closed", []), ("M", "S-99-0001", "1999", "closed", [])],
        f"archive string, run_id string, created string, status string, history array<{entry}>")
    files = spark.createDataFrame([("IN", "I-99-0001", "a.csv", 5), ("IN", "I-98-0001", "b.csv", 7), ("M", "S-99-0001", "c.csv", 1)],
                                  "archive string, run_id string, name string, size long")
    archives = spark.createDataFrame([("IN", None), ("M", None)], "archive string, merged_at string")
    entries = spark.createDataFrame(
        [("IN", "set", 1, "I-99-0001/a.csv", None), ("IN", "set", 2, "I-98-0001", None), ("IN", "set", 3, "a|b|c", "x"),
         ("IN", "own", 1, "collections/set", None), ("M", "set", 1, "S-99-0001", None)],
        "archive string, collection string, ord int, ref string, note string")
    plan = spark.createDataFrame([("IN", "I-99-0001", 1999, "S-99-0002"), ("IN", "I-98-0001", 1998, "S-98-0001")],
                                 "archive string, run_id string, id_year int, new_run_id string")
    tables = {"sessions": sessions, "files": files, "archives": archives, "collection_entries": parse_refs(entries, "ref")}

    def done(years):
        return tr.merge_catalog(plan, spark.createDataFrame([(y,) for y in years], "year int"), tables, "IN", "M", "now")

    def rows(df, *names):
        return sorted(tuple(r) for r in df.select(*names).collect())

    held = done([1998])
    assert rows(held["files"], "archive", "run_id", "name") == [("M", "S-99-0001", "c.csv"), ("M", "S-99-0002", "a.csv")]
    assert rows(held["refused"], "run_id", "refused") == [("I-98-0001", "sealed year")]
    assert [r.run_id for r in held["source_sessions"].where(F.size("history") > 0).collect()] == ["I-99-0001"]
    assert rows(held["sessions"], "run_id") == [("S-99-0001",), ("S-99-0002",)]
    assert rows(held["archives"].where("merged_at is not null"), "archive") == []
    assert rows(held["collection_entries"], "archive", "collection", "ord", "ref") == [
        ("M", "own", 1, "collections/set-IN"), ("M", "set", 1, "S-99-0001"), ("M", "set-IN", 1, "S-99-0002/a.csv"), ("M", "set-IN", 2, "I-98-0001")]
    assert rows(held["entries_left"], "collection", "ord") == [("set", 3)]
    assert rows(done([])["archives"].where("merged_at is not null"), "archive", "merged_to") == [("IN", "M")]
    nothing = done([1998, 1999])
    assert nothing["files"].count() == 1 and nothing["plan"].isEmpty()
    assert rows(nothing["archives"].where("merged_at is not null"), "archive") == []


def test_code_that_arrives_with_a_merge(spark):
    plan = spark.createDataFrame([("IN", "I-99-0001")], "archive string, run_id string")
    sidecars = spark.createDataFrame(
        [("IN", "I-99-0001", "m1", False), ("IN", "I-99-0001", "m2", False), ("IN", "I-99-0001", "m3", False), ("IN", "I-99-0001", "m4", True),
         ("IN", "I-98-0001", "m5", False)], "archive string, run_id string, code string, trashed boolean")
    manifests = spark.createDataFrame([(f"m{k}", "main.py", 10) for k in (1, 2, 4, 5)], "manifest string, entry string, bytes long")
    held = manifests.where("manifest = 'm1'")
    listed = spark.createDataFrame([("m1", "x"), ("m2", "x"), ("m2", "y"), ("m2", "z"), ("m5", "w")], "manifest string, blob string")
    blobs = spark.createDataFrame([("x", 1), ("y", 2), ("w", 3)], "digest string, bytes long")
    after, moves = tr.merge_code(plan, sidecars, manifests, listed, blobs, held, blobs.where("digest = 'x'"))
    assert sorted((r.manifest, r.arrived, r.missing) for r in after.collect()) == [("m1", False, False), ("m2", True, False), ("m3", True, True)]
    assert sorted((r.digest, r.action) for r in moves.collect()) == [("x", "present"), ("y", "copy"), ("z", "missing")]


def test_a_closure_walks_and_keeps_only_its_own_archives(spark, monkeypatch):
    written = {}
    stage = li.stage
    monkeypatch.setattr(li, "stage", lambda df, label, *a: written.setdefault(label, stage(df, label, *a)))
    edge = "archive string, run_id string, filename string, ref_user string, ref_archive string, ref_session string, ref_file string, ref_collection string, ref_asset string"
    rows = [(a, "S", "c", None, None, None, "b", None, None) for a in ("A", "B", "C", None)]
    rows += [("A", "S", "b", None, "A", "T", "x", None, None), ("A", "T", "x", None, "B", "S", "c", None, None), ("A", "S", "c", None, None, "U", None, None, None)]
    files = [(a, r, n) for a in ("A", "B", None) for r, n in (("S", "b"), ("S", "c"), ("T", "x"), ("V", "v"))]
    picked = [("A", "S", "c"), ("A", "V", None), (None, "S", "c"), ("D", "S", "c")]
    closed, elsewhere = tr.selection_closure(spark.createDataFrame(picked, "archive string, run_id string, filename string"),
                                             spark.createDataFrame(files, "archive string, run_id string, name string"), spark.createDataFrame(rows, edge))
    assert set(map(tuple, closed.collect())) == {("A", "S", "c"), ("A", "S", "b"), ("A", "T", "x"), ("A", "U", None), ("A", "V", None), (None, "S", "c"), ("D", "S", "c")}
    assert [(r.filename, r.ref_archive) for r in elsewhere.collect()] == [("x", "B")]
    assert {r._sarchive for r in written["walk-edges"].collect()} == {"A"}, "edges of archives the walk cannot enter are dealt out"


def test_near_texts_are_found_whatever_their_distance_and_wherever_they_are_held(spark, monkeypatch):
    """Parts of a few names, a few places at a time, letters beyond ASCII, and pairs of more than three edits."""
    from tracelake.functions import nearest as ne

    rng = random.Random(7)
    word = lambda most: "".join(rng.choice("ab1é\U0001f600") for _ in range(rng.randrange(most)))
    known = {a: sorted({word(13) for _ in range(70)} | {f"{a}-{'x' * n}" for n in range(12, 20)}) for a in "AB"}
    wanted = {a: sorted({word(13) for _ in range(12)} | {f"{a}-{'x' * 12}yyyyyy", "zzzzz"}) for a in "AB"}
    want = set()
    for a in "AB":
        for w in filter(None, wanted[a]):
            scored = sorted((-(1 - _edit_distance(w, c) / max(len(w), len(c))), c) for c in known[a])
            want |= {(a, w, c) for s, c in scored[:3] if -s >= 0.6}
    assert any(_edit_distance(w, c) > 3 for _a, w, c in want)
    rows = lambda texts: [(a, t) for a in "AB" for t in texts[a]] + [("A", None), (None, "ab1")]
    asked, have = spark.createDataFrame(rows(wanted), "archive string, w string"), spark.createDataFrame(rows(known), "archive string, c string")
    for name, value in (("FEW", 1), ("PART", 40), ("ASKED", 9), ("TOGETHER", 5)):
        monkeypatch.setattr(tr, name, value)
    got = {(r.archive, r.w, r.c) for r in tr.closest(asked, have, ["archive"], "w", "c").collect()}
    assert {r for r in got if r[1]} == want
    tree = ne.Tree(known["A"])
    whole = ne.nearest(wanted["A"], tree, 7, 0.6, 3)
    monkeypatch.setattr(ne, "PLACES", 5)
    assert [x.tolist() for x in ne.nearest(wanted["A"], tree, 7, 0.6, 3)] == [x.tolist() for x in whole]


def test_names_asked_are_not_written_in_all_their_variants(spark, monkeypatch):
    """What is looked up is the names themselves; their variants within three edits are a thousand times as many."""
    monkeypatch.setattr(tr, "FEW", 5)
    monkeypatch.setattr(tr, "_variants", lambda *_: pytest.fail("variants are written"))
    names = spark.range(2000).select(F.lit("A").alias("archive"), F.format_string("Customer#%09d", "id").alias("candidate"))
    asked = spark.range(0, 2000, 100).select(F.lit("A").alias("archive"), F.format_string("Custmer#%09dx", "id").alias("wanted"))
    best = {r.wanted: r.candidate for r in tr.closest(asked, names, ["archive"], "wanted", "candidate").where("place = 1").collect()}
    assert best == {f"Custmer#{i:09d}x": f"Customer#{i:09d}" for i in range(0, 2000, 100)}
