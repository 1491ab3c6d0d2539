"""Lineage: resolving references and walking the graph they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.graphs import followed
from tracelake.operators.items import SESSION
from tracelake.session import stage, stage_counted

NODE = ["archive", "run_id", "filename"]

# The default depth of a walk, of a tree and of nested collections.
MAX_DEPTH = 50
TREE_DEPTH = 3
COLLECTION_DEPTH = 8

#: Levels of a walk after which the set of nodes met is written as one table.
COMPACT = 8


# -- edges -------------------------------------------------------------------

def resolve_edges(edges: DataFrame) -> DataFrame:
    """Edges with explicit targets: an unsaid archive or session is the referrer's."""
    beside = F.col("ref_asset").isNotNull() | F.col("ref_collection").isNotNull()
    return edges.withColumns({
        "to_archive": F.coalesce("ref_archive", "archive"),
        "to_session": F.coalesce("ref_session", F.when(~beside, F.col("run_id"))),
        "to_file": F.when(~beside, F.col("ref_file")),
    })


def file_edges(edges: DataFrame) -> DataFrame:
    """Child file -> parent file, over all archives; asset labels are no files."""
    resolved = resolve_edges(edges.where("ref_asset is null and ref_collection is null"))
    return resolved.where("to_file is not null").select(
        *NODE, F.col("to_archive").alias("p_archive"), F.col("to_session").alias("p_run_id"),
        F.col("to_file").alias("p_filename"))


def current_names(renames: DataFrame) -> DataFrame:
    """What each logged name is called now.

    Follows old -> new, the last entry per old name counting, until a name no
    entry changes; a cycle ends where it would repeat. One row per logged name that
    is not its own. Chains are followed by doubling.
    """
    step = renames.groupBy(*SESSION, "old_name").agg(F.max_by("new_name", "ord").alias("new_name"))
    ends = followed(step, SESSION, "old_name", "new_name").withColumnRenamed("end", "current_name")
    same = step.where("old_name = new_name").select(*SESSION, "old_name")
    return ends.join(same, [*SESSION, "old_name"], "left_anti").select(*SESSION, "old_name", "current_name")


# -- J5, G4: where a reference leads ---------------------------------------------

def ref_status(refs: DataFrame, archives: DataFrame, sessions: DataFrame, files: DataFrame,
               names: DataFrame) -> DataFrame:
    """Whether each resolved reference leads to something, and if not, why.

    ``refs`` carries to_archive, to_session and to_file. A file that is gone is
    looked up in the rename log before it counts as missing.
    """
    known = archives.select(F.col("archive").alias("to_archive"), F.col("reachable").alias("_ok"))
    where = sessions.select(F.col("archive").alias("to_archive"), F.col("run_id").alias("to_session"),
                            F.lit(True).alias("_session"))
    there = files.select(F.col("archive").alias("to_archive"), F.col("run_id").alias("to_session"),
                         F.col("name").alias("to_file"), F.lit(True).alias("_file"))
    renamed = (
        names.join(files.select(*SESSION, F.col("name").alias("current_name")),
                   [*SESSION, "current_name"], "left_semi")
        .select(F.col("archive").alias("to_archive"), F.col("run_id").alias("to_session"),
                F.col("old_name").alias("to_file"), F.col("current_name").alias("_now"))
    )
    joined = (
        refs.join(known, "to_archive", "left").join(where, ["to_archive", "to_session"], "left")
        .join(there, ["to_archive", "to_session", "to_file"], "left")
        .join(renamed, ["to_archive", "to_session", "to_file"], "left")
    )
    local = F.col("to_archive") == F.col("archive")
    note = (
        F.when(~local & F.col("_ok").isNull(), "archive not registered")
        .when(~local & ~F.col("_ok"), "archive not mounted")
        .when(F.col("_session").isNull(), "session not found")
        .when(F.col("to_file").isNull() | F.col("_file"), F.lit(None))
        .when(F.col("_now").isNotNull(), F.concat(F.lit("renamed from "), F.col("to_file")))
        .otherwise("file is missing")
    )
    return (
        joined.withColumn("note", note)
        .withColumn("resolved", ~F.coalesce(F.col("note").startswith("archive "), F.lit(False)))
        .withColumn("exists", F.col("note").isNull() | F.col("note").startswith("renamed"))
        .withColumn("to_file", F.when(F.col("note").startswith("renamed"), F.col("_now"))
                    .otherwise(F.col("to_file")))
        .drop("_ok", "_session", "_file", "_now")
    )


def direct_dependents(edges: DataFrame) -> DataFrame:
    """Every (file, artifact derived from it) pair of one archive."""
    same = edges.where("ref_archive is null and ref_asset is null and ref_file is not null")
    return resolve_edges(same).select(
        F.col("archive"), F.col("to_session").alias("run_id"), F.col("to_file").alias("filename"),
        F.col("run_id").alias("child_run_id"), F.col("filename").alias("child_filename"))


def inbound_references(edges: DataFrame, related: DataFrame) -> DataFrame:
    """What other sessions of the archive say about a session."""
    derived = edges.where("ref_archive is null and ref_asset is null and ref_session <> run_id").select(
        "archive", F.col("ref_session").alias("run_id"), F.col("run_id").alias("from_run_id"),
        F.col("filename").alias("from_filename"), F.lit("derived_from").alias("via"))
    runs = related.where("ref_archive is null and ref_session <> run_id").select(
        "archive", F.col("ref_session").alias("run_id"), F.col("run_id").alias("from_run_id"),
        F.lit(None).cast("string").alias("from_filename"), F.lit("related_run").alias("via"))
    return derived.unionByName(runs)


def asset_usage(edges: DataFrame) -> DataFrame:
    """Artifacts built from each asset, with what version they saw."""
    return edges.where("ref_asset is not null").select(
        "archive", F.col("ref_asset").alias("asset_id"), "run_id", "filename",
        F.col("ref_sha256").alias("sha256"), F.col("ref_fidelity").alias("fidelity"),
    ).orderBy("archive", "asset_id", "run_id", "filename")


def rename_referrers(edges: DataFrame, renames: DataFrame, mode: str = "local") -> DataFrame:
    """Edges that name a file about to be renamed.

    ``local`` looks in the file's own archive, ``all`` also elsewhere, and
    ``none`` rewrites nothing. ``renames``: archive, run_id, old_name, new_name.
    """
    named = resolve_edges(edges.where("ref_asset is null and ref_file is not null"))
    target = renames.select(F.col("archive").alias("to_archive"), F.col("run_id").alias("to_session"),
                            F.col("old_name").alias("to_file"), "new_name")
    hits = named.join(target, ["to_archive", "to_session", "to_file"])
    if mode == "none":
        hits = hits.where(F.lit(False))
    elif mode == "local":
        hits = hits.where(F.col("archive") == F.col("to_archive"))
    return hits.select(*NODE, "ord", F.col("to_archive"), F.col("to_session"),
                       F.col("to_file").alias("old_name"), "new_name")


def artifact_paths(artifacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Path of each artifact below its archive; null when the session is unknown."""
    known = sessions.select(*SESSION, "rel_path")
    return artifacts.join(known, SESSION, "left").withColumn(
        "path", F.concat(F.col("rel_path"), F.lit("/"), F.col("filename"))).drop("rel_path")


def session_detail(sessions: DataFrame, related: DataFrame, sidecars: DataFrame,
                   edges: DataFrame) -> DataFrame:
    """Everything recorded about each session, as ordered rows.

    Long form: a section number, a position inside it and a text. A session of
    any size stays spread, where a nested list would need it in one place.
    """
    from tracelake.functions.text import provenance_label, ref_label

    head = sessions.select(*SESSION, F.lit(1).alias("section"), F.lit("").alias("item"),
                           F.lit(0).alias("ord"), F.concat_ws(" ", "created", "status", "description").alias("text"))
    runs = related.select(*SESSION, F.lit(2).alias("section"), F.lit("").alias("item"), F.lit(0).alias("ord"),
                          ref_label(F.col("ref_archive"), F.col("ref_session"), F.col("ref_file")).alias("text"))
    made = sidecars.where(~F.col("trashed")).select(
        *SESSION, F.lit(3).alias("section"), F.col("filename").alias("item"), F.lit(0).alias("ord"),
        provenance_label(F.col("source"), F.col("origin"), F.col("repo"), F.col("commit"),
                         F.col("dirty")).alias("text"))
    came = edges.select(*SESSION, F.lit(4).alias("section"), F.col("filename").alias("item"), "ord",
                        ref_label(F.col("ref_archive"), F.col("ref_session"), F.col("ref_file")).alias("text"))
    rows = runs.unionByName(made).unionByName(came)
    return (head.unionByName(rows.join(sessions.select(*SESSION), SESSION, "left_semi"))
            .orderBy("archive", "run_id", "section", "item", "ord"))


# -- the walk ------------------------------------------------------------------

def walk(seeds: DataFrame, edges: DataFrame, seed: list[str], node: list[str], source: list[str],
         target: list[str], max_depth: int | None = None, expand: Column | None = None) -> DataFrame:
    """Breadth-first reach of every seed, all seeds at once.

    ``seeds`` holds the seed columns and the node columns it starts from; an
    edge leads from ``source`` to ``target``. Each round is one join and one
    anti join, written to the shared folder, which cuts the plan and survives
    lost executors. Returns (seed, node, depth) with the least depth, without
    the starting nodes. ``expand`` says which nodes to go on from.

    Without ``max_depth`` the walk ends when nothing new is met. With it, nodes
    of the last level that lead on to nodes not met are marked ``truncated``.

    With no seed columns the result is the set of reached nodes, linear in the
    graph; with seeds it has one row per pair reached.
    """
    renamed = edges.select(*[F.col(s).alias("_s" + n) for s, n in zip(source, node)],
                           *[F.col(t).alias("_t" + n) for t, n in zip(target, node)])
    renamed = stage(renamed.distinct(), "walk-edges")
    frontier = stage(seeds.select(*seed, *node).distinct(), "walk-seeds")
    seen, found, depth = frontier, None, 0

    def onward() -> DataFrame:
        """Nodes one edge on, met or not, with the node they are reached from."""
        on = [F.col(n) == F.col("_s" + n) for n in node]
        start = frontier if expand is None else frontier.where(expand)
        return start.join(renamed, on).select(*seed, *[F.col("_t" + n).alias(n) for n in node], *["_s" + n for n in node])

    while max_depth is None or depth < max_depth:
        step = onward().select(*seed, *node).distinct()
        fresh, rows = stage_counted(step.join(seen, [*seed, *node], "left_anti"), "walk")
        if rows == 0:
            break
        depth += 1
        seen = seen.unionByName(fresh)
        if depth % COMPACT == 0:
            seen = stage(seen, "walk-seen")
        level = fresh.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        frontier = fresh
    if found is None:
        found = seeds.select(*seed, *node, F.lit(0).alias("depth")).limit(0)
    if max_depth is None:
        return found
    found = found.withColumn("truncated", F.lit(False))
    if depth == max_depth:
        more = onward().join(seen, [*seed, *node], "left_anti").select(
            *seed, *[F.col("_s" + n).alias(n) for n in node], F.lit(depth).alias("depth"), F.lit(True).alias("_more")).distinct()
        found = found.drop("truncated").join(more, [*seed, *node, "depth"], "left").withColumn(
            "truncated", F.coalesce("_more", F.lit(False))).drop("_more")
    return found


def upstream(seeds: DataFrame, edges: DataFrame, archives: DataFrame,
             max_depth: int = MAX_DEPTH) -> DataFrame:
    """Everything each seed file was derived from, across archives (G1).

    ``seeds`` holds archive, run_id and filename. Nodes of an archive that cannot
    be reached are listed as unresolved and not followed. Where ``max_depth`` ends
    a walk that could go on, the last nodes are ``truncated``.
    """
    start = seeds.select(*[F.col(c).alias("seed_" + c) for c in NODE], *NODE)
    own = file_edges(edges).join(
        archives.where("reachable").select("archive"), "archive", "left_semi")
    parents = ["p_archive", "p_run_id", "p_filename"]
    got = walk(start, own, ["seed_" + c for c in NODE], NODE, NODE, parents, max_depth)
    known = archives.select("archive", "reachable")
    return got.join(known, "archive", "left").withColumn(
        "unresolved", ~F.coalesce("reachable", F.lit(False))).drop("reachable")


def downstream(seeds: DataFrame, edges: DataFrame, also_search: list[str] | None = None,
               max_depth: int = MAX_DEPTH) -> DataFrame:
    """Everything derived from each seed, in its archive and those named.

    ``also_search`` None looks in the seed's own archive only.
    """
    seed = ["seed_" + c for c in NODE]
    start = seeds.select(*[F.col(c).alias("seed_" + c) for c in NODE], *NODE)
    links = file_edges(edges)
    if also_search is None:
        links = links.where(F.col("archive") == F.col("p_archive"))
        return walk(start, links, seed, NODE, ["p_archive", "p_run_id", "p_filename"], NODE, max_depth)
    # A child counts when it lies in the seed's archive or a searched one.
    kept = walk(start, links, seed, NODE, ["p_archive", "p_run_id", "p_filename"], NODE, max_depth,
                expand=(F.col("archive") == F.col("seed_archive")) | F.col("archive").isin(*also_search))
    return kept.where((F.col("archive") == F.col("seed_archive")) | F.col("archive").isin(*also_search))


def provenance_tree(roots: DataFrame, edges: DataFrame, files: DataFrame, archives: DataFrame,
                    direction: str = "up", depth: int = TREE_DEPTH) -> DataFrame:
    """Branches below each root as an edge list, one row per child shown.

    A node met before in the same tree is marked ``seen`` and not opened again;
    a node at the depth limit that has more below is ``truncated``; a node of an
    unreachable archive is unresolved. Levels are built breadth-first, so the
    showing that is opened is the one nearest the root.
    """
    seed = ["root_" + c for c in NODE]
    links = file_edges(edges)
    parents = ["p_archive", "p_run_id", "p_filename"]
    if direction == "up":
        ends = [*[F.col(c).alias("_s" + c) for c in NODE], *[F.col(p).alias(c) for p, c in zip(parents, NODE)]]
    else:
        links = links.where("archive = p_archive")
        ends = [*[F.col(p).alias("_s" + c) for p, c in zip(parents, NODE)], *[F.col(c).alias(c) for c in NODE]]
    links = stage(links.select(*ends).distinct(), "tree-edges")
    reachable = archives.where("reachable").select("archive")
    level = roots.select(*[F.col(c).alias("root_" + c) for c in NODE], *NODE).distinct()
    level = stage(level.withColumn("id", F.monotonically_increasing_id()), "tree-roots").drop("id")
    opened, out = level, None
    for d in range(1, depth + 1):
        shown = level.select(*seed, *[F.col(c).alias("_s" + c) for c in NODE]).join(
            links, ["_s" + c for c in NODE])
        # One showing per node is opened: the first among parents at this level.
        nth = Window.partitionBy(*seed, *NODE).orderBy(*["_s" + c for c in NODE])
        shown = shown.withColumn("_again", F.row_number().over(nth) > 1)
        shown = shown.join(opened.select(*seed, *NODE, F.lit(True).alias("_old")), [*seed, *NODE], "left")
        shown = shown.withColumn("seen", F.coalesce("_old", F.lit(False)) | F.col("_again")).drop("_old", "_again")
        shown = shown.join(reachable.withColumn("_ok", F.lit(True)), "archive", "left").withColumn(
            "resolved", F.coalesce("_ok", F.lit(False))).drop("_ok")
        shown = stage(shown.withColumn("depth", F.lit(d)), f"tree-{d}")
        level = shown.where("not seen and resolved").select(*seed, *NODE)
        opened = opened.unionByName(level)
        out = shown if out is None else out.unionByName(shown)
        if level.isEmpty():
            break
    more = links.select(*[F.col("_s" + c).alias(c) for c in NODE]).distinct().withColumn("_more", F.lit(True))
    there = files.select(*SESSION, F.col("name").alias("filename"), F.lit(True).alias("_there"))
    cut = F.when(~F.col("resolved"), True).when(F.col("seen") | (F.col("depth") < depth), False).otherwise(
        F.coalesce("_more", F.lit(False)))
    return (
        out.join(more, NODE, "left").join(there, NODE, "left")
        .select(*seed, *[F.col("_s" + c).alias("from_" + c) for c in NODE], *NODE, "depth", "seen",
                "resolved", cut.alias("truncated"),
                (F.col("resolved") & F.coalesce("_there", F.lit(False))).alias("exists"))
    )


# -- G6-G8: collections --------------------------------------------------------

def collection_links(entries: DataFrame) -> DataFrame:
    """Parent -> child between collections of one archive.

    ``entries`` is parsed (ref_*); references to other archives are not ours.
    """
    return entries.where("ref_collection is not null and ref_archive is null and ref_user is null").select(
        "archive", F.col("collection").alias("parent"), F.col("ref_collection").alias("child"))


def collection_tree(links: DataFrame, collections: DataFrame, roots: DataFrame,
                    max_depth: int = COLLECTION_DEPTH) -> DataFrame:
    """Nested collections below each root, with cycle and depth marks."""
    known = collections.select("archive", F.col("collection").alias("child"))
    links = stage(links.join(known, ["archive", "child"], "left_semi").distinct(), "collection-links")
    level = roots.select("archive", F.col("collection").alias("root"), F.col("collection").alias("name"),
                         F.array("collection").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        shown = level.join(links.withColumnRenamed("parent", "name"), ["archive", "name"]).select(
            "archive", "root", F.col("name").alias("parent"), F.col("child").alias("name"),
            F.concat("path", F.array("child")).alias("path"), F.lit(depth).alias("depth"),
            F.array_contains("path", F.col("child")).alias("cycle"))
        shown, rows = stage_counted(
            shown.withColumn("truncated", ~F.col("cycle") & F.lit(depth == max_depth)), f"coll-{depth}")
        out = shown if out is None else out.unionByName(shown)
        level = shown.where("not cycle").select("archive", "root", "name", "path")
        if rows == 0:
            break
    return out


def collections_reached(links: DataFrame) -> DataFrame:
    """Every (start, target) where start contains target at any depth."""
    starts = links.select("archive", F.col("parent").alias("start"), F.col("parent").alias("name")).distinct()
    got = walk(starts, links.select("archive", "parent", "child"), ["start"], ["archive", "name"],
               ["archive", "parent"], ["archive", "child"])
    # A start met again on a cycle is its own target.
    again = (links.select("archive", F.col("parent").alias("name"), F.col("child").alias("start"))
             .join(got.select("archive", "start", "name"), ["archive", "start", "name"], "left_semi")
             .select("archive", F.col("name").alias("start"), F.col("name").alias("name")))
    own = links.where("parent = child").select("archive", F.col("parent").alias("start"), F.col("parent").alias("name"))
    return (got.select("archive", "start", "name").unionByName(again).unionByName(own).distinct()
            .withColumnRenamed("name", "target"))


def hierarchy_roots(links: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections nothing contains, plus those only a cycle reaches."""
    known = collections.select("archive", "collection")
    contained = links.select("archive", F.col("child").alias("collection"))
    top = known.join(contained, ["archive", "collection"], "left_anti")
    start = top.select("archive", F.col("collection").alias("name"))
    reached = walk(start, links, [], ["archive", "name"], ["archive", "parent"], ["archive", "child"])
    covered = start.unionByName(reached.select("archive", "name")).withColumnRenamed("name", "collection")
    hidden = known.join(covered, ["archive", "collection"], "left_anti")
    return top.withColumn("in_cycle", F.lit(False)).unionByName(hidden.withColumn("in_cycle", F.lit(True)))
