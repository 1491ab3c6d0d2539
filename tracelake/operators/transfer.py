"""Moving sessions between archives: plans, rewrites and the stamps they leave."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import ids
from tracelake.functions.nearest import Tree, nearest
from tracelake.functions.refs import format_ref
from tracelake.functions.text import COLLECTION_MAX_LENGTH, slugify
from tracelake.operators.items import ITEM, SESSION
from tracelake.operators.lineage import NODE, walk
from tracelake.operators.skew import attach, rank_in_groups, running_sum
from tracelake.session import stage

HISTORY_ENTRY = "struct<action:string,at:string,by:string,file:string,note:string>"


def history_entry(action: str, at: Column, note: Column, by: Column | None = None,
                  file: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(action).alias("action"), at.alias("at"),
                    (none if by is None else by).alias("by"),
                    (none if file is None else file).alias("file"), note.alias("note"))


def history_of(cat) -> DataFrame:
    """Sessions of a bound catalog with their history as an array of entries."""
    at, empty = F.col("created"), F.array().cast(f"array<{HISTORY_ENTRY}>")
    merged = F.when(F.col("merged_note").isNotNull(), F.array(
        history_entry("merged", at, F.lit(None).cast("string")),
        history_entry("merged", at, F.col("merged_note"))))
    adopted = F.when(F.col("adopted_note").isNotNull(), F.array(
        history_entry("adopted", at, F.col("adopted_note"))))
    return cat.sessions.withColumn("history", F.concat(
        F.coalesce(merged, empty), F.coalesce(adopted, empty)))


def merged_note(history: Column) -> Column:
    """Where a session was merged to, from the last entry that says so."""
    said = F.filter(history, lambda h: (h["action"] == "merged") & (h["note"] != ""))
    return F.get(said, F.size(said) - 1)["note"]


# -- W2, W3: names and ids for a batch ------------------------------------------

def resolve_names(requests: DataFrame, existing: DataFrame, order: list[str], slice_by: Column,
                  policy: str = "duplicate") -> DataFrame:
    """File names for a batch of writes that may clash.

    ``requests`` has archive, run_id and requested; ``existing`` has archive,
    run_id and name. Adds ``filename`` (null when refused), ``original_name`` and
    ``duplicate_index`` (null unless renamed), and ``refused``. Under
    ``duplicate`` a clash takes the next free ``-NNN``; a number is also taken
    when the batch itself asks for a file of that name. ``overwrite`` keeps the
    last request per name, ``cancel`` refuses all but a first one on a free name.
    """
    keys = [*SESSION, "requested"]
    taken = existing.select(*SESSION, F.col("name").alias("requested"), F.lit(1).alias("_taken")).distinct()
    ranked = rank_in_groups(requests, keys, slice_by, [F.col(c) for c in order], "_nth")
    ranked = ranked.join(taken, keys, "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    none = F.lit(None).cast("string")
    if policy == "overwrite":
        size = requests.groupBy(*keys).agg(F.count("*").alias("_size"))
        last = attach(ranked, size, keys, "_size", order, "inner")
        return last.where(F.col("_nth") == F.col("_size")).withColumns({
            "filename": F.col("requested"), "original_name": none,
            "duplicate_index": none.cast("int"), "refused": none}).drop("_nth", "_size", "_taken")
    if policy == "cancel":
        free = (F.col("_nth") == 1) & (F.col("_taken") == 0)
        return ranked.withColumns({
            "filename": F.when(free, F.col("requested")), "original_name": none,
            "duplicate_index": none.cast("int"),
            "refused": F.when(~free, "name already taken")}).drop("_nth", "_taken")

    # The nth clash takes the nth number that is free. Numbers in use are ranked,
    # and number u of rank i is passed by every n with u - i < n.
    stem, suffix = ids.split_suffix(F.col("requested"))
    shape = r"^(.+)-(\d{3,})$"
    numbered = (
        existing.select(*SESSION, F.col("name").alias("requested"))
        .unionByName(requests.select(*keys)).distinct()
        .select(*SESSION, stem.alias("_stem"), suffix.alias("_suffix"))
        .where(F.col("_stem").rlike(shape))
        .select(*SESSION, F.concat(F.regexp_extract("_stem", shape, 1), F.col("_suffix")).alias("requested"),
                F.regexp_extract("_stem", shape, 2).try_cast("bigint").alias("_used"))
        .where("_used >= 1").distinct().join(requests.select(*keys), keys, "left_semi")
    )
    passed = rank_in_groups(numbered, keys, F.floor(F.col("_used") / 1000), [F.col("_used")], "_i").select(
        *keys, (F.col("_used") - F.col("_i")).alias("_at"), F.lit(1).alias("_step"))
    asked = ranked.withColumn("_n", F.col("_nth") - 1 + F.col("_taken"))
    line = asked.select(*keys, (F.col("_n") - 1).alias("_at"), F.lit(0).alias("_step")).unionByName(passed)
    steps = running_sum(line, keys, F.floor(F.col("_at") / 1000), [F.col("_at"), F.desc("_step")],
                        F.col("_step").cast("bigint"), "_skip").where("_step = 0").select(
        *keys, (F.col("_at") + 1).alias("_n"), "_skip")
    number = F.col("_n") + F.col("_skip")
    named = asked.join(steps, [*keys, "_n"], "left").withColumn(
        "_number", F.when(F.col("_n") > 0, number))
    renamed = F.col("_number").isNotNull()
    return named.withColumns({
        "filename": F.when(renamed, ids.duplicate_name(F.col("requested"), F.col("_number")))
        .otherwise(F.col("requested")),
        "original_name": F.when(renamed, F.col("requested")),
        "duplicate_index": F.col("_number").cast("int"),
        "refused": none,
    }).drop("_nth", "_taken", "_n", "_skip", "_number")


def next_ids(incoming: DataFrame, existing: DataFrame, prefix: str = "S-",
             this_year: int | None = None) -> DataFrame:
    """A new id for every incoming session: its own year, the next free numbers.

    ``incoming`` and ``existing`` have run_id. Which prefix an existing id has
    does not matter for its number. Ids that do not parse count as this year's.
    """
    year = F.coalesce(ids.id_year(F.col("run_id")), F.lit(this_year).cast("int"))
    used = (existing.select(ids.id_year(F.col("run_id")).alias("id_year"), ids.id_number(F.col("run_id")).alias("n"))
            .where("id_year is not null").groupBy("id_year").agg(F.max("n").alias("_top")))
    number = F.coalesce(ids.id_number(F.col("run_id")), F.lit(0))
    ranked = rank_in_groups(incoming.withColumn("id_year", year), ["id_year"],
                            F.floor(number / 4096), [number, F.col("run_id")], "_nth")
    return ranked.join(used, "id_year", "left").withColumn("new_run_id", ids.format_id(
        prefix, F.pmod("id_year", F.lit(100)), F.coalesce("_top", F.lit(0)) + F.col("_nth"))).drop("_nth", "_top")


# -- J11, J16, F15, T14 ------------------------------------------------------------

def compare_copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same and differing files of two copies of each session.

    A file the right side lacks differs; files only there do not count.
    """
    other = right.select(*ITEM, F.col("sha256").alias("_other"))
    same = F.coalesce(F.col("sha256") == F.col("_other"), F.lit(False))
    return left.select(*ITEM, "sha256").join(other, ITEM, "left").groupBy(*SESSION).agg(
        F.count_if(same).alias("same"), F.count_if(~same).alias("differing"))


def already_adopted(sessions: DataFrame) -> DataFrame:
    """Origins recorded when sessions were adopted.

    The origin is the address in the note, so one equality join finds it.
    """
    entry = F.explode(F.filter("history", lambda h: h["action"] == "adopted"))
    return sessions.select(F.col("run_id").alias("adopted_as"), entry.alias("h")).select(
        "adopted_as", F.regexp_extract("h.note", r"([a-z]+://.*)$", 1).alias("origin"))


def unmerged(sessions: DataFrame) -> DataFrame:
    return sessions.where(merged_note(F.col("history")).isNull())


def safe_to_delete(sessions: DataFrame, archives: DataFrame) -> DataFrame:
    """Intake archives and how many of their sessions exist nowhere else."""
    left = unmerged(sessions).groupBy("archive").agg(F.count("*").alias("unmerged"))
    return archives.where("kind = 'intake'").select("archive").join(left, "archive", "left").select(
        "archive", F.coalesce("unmerged", F.lit(0)).alias("unmerged"),
        (F.coalesce("unmerged", F.lit(0)) == 0).alias("safe"))


# -- T5, T9, T12: plans ----------------------------------------------------------

def session_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy(*SESSION).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def plan_merge(source: DataFrame, unreadable: DataFrame, files: DataFrame, dest_ids: DataFrame,
               this_year: int) -> tuple[DataFrame, DataFrame]:
    """What merging an intake archive would move, and what it leaves (T5).

    Sessions already merged or still open stay, as do unreadable ones. The rest
    get ids of the year their work happened in.
    """
    note = merged_note(F.col("history"))
    reason = F.when(note.isNotNull(), F.concat(F.lit("already merged as "), note)).when(
        F.col("status") == "open", "still open")
    judged = source.withColumn("note", reason)
    skipped = judged.where("note is not null").select(*SESSION, "note").unionByName(
        unreadable.select(*SESSION, F.lit("unreadable record").alias("note")))
    moving = next_ids(judged.where("note is null").select(*SESSION), dest_ids, "S-", this_year)
    zero = F.lit(0).cast("bigint")
    plan = moving.join(session_bytes(files), SESSION, "left").withColumns(
        {n: F.coalesce(n, zero) for n in ("n_files", "bytes")})
    return plan, skipped


def plan_adopt(source: DataFrame, owner: str, scheme: str, files: DataFrame, dest: DataFrame,
               this_year: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What copying sessions out of a fragment would take.

    A session whose address is already recorded in the destination is skipped.
    """
    chosen = source if wanted is None else source.join(wanted.select("run_id"), "run_id", "left_semi")
    origin = F.concat(F.lit(f"{scheme}{owner or 'unknown'}/"), F.col("archive"), F.lit("/"), F.col("run_id"))
    known = already_adopted(dest).groupBy("origin").agg(F.min("adopted_as").alias("adopted_as"))
    judged = chosen.withColumn("origin", origin).join(known, "origin", "left")
    skipped = judged.where("adopted_as is not null").select(
        *SESSION, F.concat(F.lit("already adopted as "), F.col("adopted_as")).alias("note"))
    moving = next_ids(judged.where("adopted_as is null").select(*SESSION, "origin"), dest.select("run_id"),
                      "S-", this_year)
    zero = F.lit(0).cast("bigint")
    plan = moving.join(session_bytes(files), SESSION, "left").withColumns(
        {n: F.coalesce(n, zero) for n in ("n_files", "bytes")})
    return plan, skipped


def sealed_conflicts(plan: DataFrame, seals: DataFrame) -> DataFrame:
    """Sealed years a plan would add sessions to."""
    return (plan.groupBy(F.col("id_year").alias("year")).agg(F.count("*").alias("n_sessions"))
            .join(seals.select("year"), "year", "left_semi"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """Sessions, files and bytes of a plan, foreign bytes and new ids apart."""
    foreign = F.col("foreign") if "foreign" in plan.columns else F.lit(False)
    new = F.col("new_run_id") if "new_run_id" in plan.columns else F.col("run_id")
    return plan.agg(
        F.count("*").alias("n_sessions"), F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum(F.when(foreign, F.col("bytes"))), F.lit(0)).alias("foreign_bytes"),
        F.count_if(new != F.col("run_id")).alias("n_renamed"))


# -- T6, T7, T10: rewriting --------------------------------------------------------

def rewrite_refs(refs: DataFrame, id_map: DataFrame, dest: str,
                 repairs: DataFrame | None = None) -> DataFrame:
    """References of moved sessions, as they read at the destination.

    A chosen repair comes first, since it is spelled in source terms. A reference
    to the destination archive becomes local, then a renamed session gets its new
    id. Every other part, pins included, is carried along. ``refs`` has the ref_*
    columns, a run_id and a filename; ``id_map`` has run_id and new_run_id.
    """
    out = refs
    if repairs is not None:
        at = ["run_id", "filename", "ref_session", "ref_file"]
        fix = repairs.select(*[F.col(c).alias("_" + c) for c in at],
                             "fixed_session", "fixed_file", F.lit(True).alias("_fix"))
        same = [F.col(c).eqNullSafe(F.col("_" + c)) if c != "run_id" else F.col(c) == F.col("_" + c) for c in at]
        condition = F.col("ref_archive").isNull()
        for s in same:
            condition = condition & s
        out = (out.join(fix, condition, "left")
               .withColumn("ref_session", F.when(F.col("_fix"), F.col("fixed_session")).otherwise(F.col("ref_session")))
               .withColumn("ref_file", F.when(F.col("_fix"), F.col("fixed_file")).otherwise(F.col("ref_file")))
               .drop(*["_" + c for c in at], "fixed_session", "fixed_file", "_fix"))
    out = out.withColumn("ref_archive", F.when(F.col("ref_archive") != dest, F.col("ref_archive")))
    target = id_map.select(F.col("run_id").alias("ref_session"), F.col("new_run_id").alias("_new_ref"))
    home = id_map.select("run_id", F.col("new_run_id").alias("_new_home"))
    return (
        out.join(target, "ref_session", "left").join(home, "run_id")
        .withColumn("ref_session", F.when(F.col("ref_archive").isNull() & F.col("_new_ref").isNotNull(), F.col("_new_ref"))
                    .otherwise(F.col("ref_session")))
        .withColumn("old_run_id", F.col("run_id")).withColumn("run_id", F.col("_new_home"))
        .withColumn("archive", F.lit(dest)).drop("_new_ref", "_new_home")
    )


def carry_collections(incoming: DataFrame, existing: DataFrame, source: str) -> DataFrame:
    """New names for incoming collections: a clash never merges into a set.

    A taken name gets the source's name behind it, then 2, 3, ... until free.
    """
    names = incoming.select("collection").distinct()
    taken = existing.select(F.col("collection").alias("new_name")).distinct()
    first = names.withColumn("new_name", F.col("collection"))
    done = first.join(taken, "new_name", "left_anti")
    waiting = first.join(taken, "new_name", "left_semi").select("collection")
    attempt = 1
    while not waiting.isEmpty():
        number = "" if attempt == 1 else f"-{attempt}"
        # The number stays whole, then the source's name, where the name would be too long: the base is cut for them.
        tail = f"-{source[:COLLECTION_MAX_LENGTH - len(number) - 2]}{number}"
        base = F.rtrim(F.substring("collection", 1, max(COLLECTION_MAX_LENGTH - len(tail), 1)))
        tried = waiting.withColumn("new_name", slugify(F.concat(base, F.lit(tail))))
        # Two incoming names may shorten to one slug; the first of them gets it.
        mine = tried.groupBy("new_name").agg(F.min("collection").alias("collection"))
        free = mine.join(taken, "new_name", "left_anti").join(done.select("new_name"), "new_name", "left_anti")
        free = stage(free.select("collection", "new_name"), "collection-names")
        done = done.select("collection", "new_name").unionByName(free)
        waiting = stage(waiting.join(free.select("collection"), "collection", "left_anti"), "collection-waiting")
        attempt += 1
    return done.select("collection", "new_name", (F.col("collection") != F.col("new_name")).alias("renamed"))


def remap_entries(entries: DataFrame, id_map: DataFrame, names: DataFrame, dest: str) -> DataFrame:
    """Collection entries moved to the destination's ids and names.

    ``entries`` is parsed; malformed ones are left behind. Returns the entries
    with their new reference text.
    """
    good = entries.where("ref_error is null").withColumn(
        "ref_archive", F.when(F.col("ref_archive") != dest, F.col("ref_archive")))
    target = id_map.select(F.col("run_id").alias("ref_session"), F.col("new_run_id").alias("_new"))
    child = names.select(F.col("collection").alias("ref_collection"), F.col("new_name").alias("_child"))
    own = names.select("collection", "new_name")
    local = F.col("ref_archive").isNull() & F.col("_new").isNotNull()
    return (
        good.join(target, "ref_session", "left").join(child, "ref_collection", "left").join(own, "collection")
        .withColumn("ref_session", F.when(local, F.col("_new")).otherwise(F.col("ref_session")))
        .withColumn("ref_collection", F.coalesce("_child", "ref_collection"))
        .withColumn("new_ref", format_ref("ref_"))
        .select("collection", "new_name", "ord", "ref", "new_ref", "note")
    )


def stamp_history(sessions: DataFrame, notes: DataFrame, action: str, at: str, by: str | None = None) -> DataFrame:
    """Append one history entry per noted session."""
    entry = history_entry(action, F.lit(at), F.col("_note"), F.lit(by).cast("string"))
    said = notes.select(*SESSION, F.col("note").alias("_note"))
    return sessions.join(said, SESSION, "left").withColumn(
        "history", F.when(F.col("_note").isNotNull(), F.array_append("history", entry))
        .otherwise(F.col("history"))).drop("_note")


# -- J14, T8: repairs -----------------------------------------------------------------

# How close a suggestion must be, and how many are made.
CUTOFF = 0.6
SUGGESTIONS = 3
#: A block of at most this many candidates is compared without an index.
FEW = 500
#: How many candidates and how many texts asked a task holds at once, and how many of these it looks up together.
PART, ASKED, TOGETHER = 250_000, 100_000, 5_000


def _closeness(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _lengths(df: DataFrame, column: str) -> list[int]:
    return [r[0] for r in df.where(F.col(column).isNotNull()).select(F.length(column)).distinct().collect()]


def _variants(df: DataFrame, column: str, edits: int, lengths: list[int]) -> DataFrame:
    """``df`` with one row per way in which its text can be one side of a pair that ``edits`` edits set apart.

    On the side of a text an edit either leaves a letter out or puts a mark in its place. Two texts are within ``edits``
    edits if some of their variants are equal, with one ``_edits`` for each mark and each letter left out of either. Letters
    change from left to right, and of equal neighbours the first goes out. Variants that no text of one of the other
    side's ``lengths`` can meet are not made. ``_variant`` is a hash, so pairs have to be confirmed.

    A text of 18 letters has some 1,300 variants within three edits: this is for few texts, :func:`closest` searches.
    """
    text, at, out_, marks = F.col("_text"), F.col("_at"), F.col("_out"), F.col("_marks")
    others = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def can_meet(gone: Column, marked: Column, last: bool) -> Column:
        def with_length(n: Column) -> Column:
            more = F.col("_length") - n
            at_last = gone if last else F.greatest(gone, more)
            return (at_last >= more) & (2 * at_last - more + marked <= edits)
        return F.exists(others, with_length)

    out = df.where(F.col(column).isNotNull()).withColumns({"_text": F.col(column), "_at": F.lit(1), "_out": F.lit(0), "_marks": F.lit(0),
                                                           "_length": F.length(column)})
    for _ in range(edits):
        none = F.array().cast("array<int>")
        places = F.when(at <= F.length(text), F.sequence(at, F.length(text))).otherwise(none)
        first = F.filter(places, lambda i: (i == at) | (F.substring(text, i, F.lit(1)) != F.substring(text, i - 1, F.lit(1))))

        def changed(i: Column, put: str) -> Column:
            gone, marked = (out_, marks + 1) if put else (out_ + 1, marks)
            return F.struct(F.concat(F.substring(text, F.lit(1), i - 1), F.lit(put), F.substring(text, i + 1, F.length(text))).alias("text"),
                            (i + len(put)).alias("at"), gone.alias("out"), marked.alias("marks"))

        marked = F.transform(F.when(can_meet(out_, marks + 1, False), places).otherwise(none), lambda i: changed(i, "\x01"))
        shorter = F.transform(F.when(can_meet(out_ + 1, marks, False), first).otherwise(none), lambda i: changed(i, ""))
        whole = F.struct(text.alias("text"), (F.length(text) + 1).alias("at"), out_.alias("out"), marks.alias("marks"))
        out = out.withColumn("_next", F.explode(F.concat(marked, shorter, F.array(whole)))).withColumns(
            {f"_{c}": F.col(f"_next.{c}") for c in ("text", "at", "out", "marks")}).drop("_next")
    out = out.where(can_meet(out_, marks, True))
    return out.withColumns({"_variant": F.xxhash64("_text"), "_edits": out_.cast("tinyint")}).select(*df.columns, "_variant", "_edits", "_marks")


def _searched(asked: DataFrame, names: DataFrame, places: DataFrame, block: list[str], wanted: str, candidate: str, edits: int, slices: int) -> DataFrame:
    """(block, wanted, candidate): for each wanted text the best of every part of its block, within ``edits`` edits.

    ``names`` has the ``_part`` of each candidate, ``places`` the parts of each block. A part meets the texts asked
    of its blocks in ``slices``, each group by itself; a task holds one part and one slice at a time.
    """
    import pyarrow as pa

    out = T.StructType([asked.schema[c] for c in [*block, wanted]] + [names.schema[candidate]])
    columns = out.fieldNames()
    salt = F.pmod(F.xxhash64(wanted), F.lit(slices)).cast("int")
    left = asked.join(places, block).select("_part", salt.alias("_slice"), *block, wanted)
    right = names.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("_part", "_slice", *block, candidate)
    # Groups are few and heavy: tasks are counted, not made from bytes.
    tasks = min(2000, 2 * slices * places.select("_part").distinct().count())
    key = ["_part", "_slice"]

    def met(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in columns}

        def by_block(table: pa.Table, text: str) -> dict[tuple, list[str]]:
            rows: dict[tuple, list[str]] = {}
            for *at, value in zip(*(table.column(c).to_pylist() for c in [*block, text])):
                rows.setdefault(tuple(at), []).append(value)
            return rows

        have = by_block(theirs, candidate)
        for at, texts in by_block(ours, wanted).items():
            there = sorted(have.get(at, ()))
            tree = Tree(there)
            for i in range(0, len(texts), TOGETHER):
                some = texts[i:i + TOGETHER]
                a, b = nearest(some, tree, edits, CUTOFF, SUGGESTIONS)
                for c, value in zip(block, at):
                    found[c] += [value] * len(a)
                found[wanted] += [some[x] for x in a]
                found[candidate] += [there[x] for x in b]
        types = [*(ours.schema.field(c).type for c in columns[:-1]), theirs.schema.field(candidate).type]
        return pa.table([pa.array(found[c], t) for c, t in zip(columns, types)], names=columns)

    return left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(met, out)


def closest(broken: DataFrame, known: DataFrame, block: list[str], wanted: str, candidate: str,
            edits: int = 3) -> DataFrame:
    """The nearest candidates of each wanted text in its block, best first.

    Similarity is 1 - edit distance / longer length, at least ``CUTOFF``; ties go
    by name; at most ``SUGGESTIONS`` are kept. Candidates are sorted and cut into parts, each of which is
    searched as a tree of prefixes, with one edit, with two and so on. A wanted text goes on to more edits only
    while a text with more of them could still be among its best. ``edits`` says from where on edits are
    added in larger steps; texts of any distance that the similarity allows are found.
    """
    # A block of few candidates is compared outright: a bounded number of pairs
    # per wanted text. Only larger blocks are searched.
    small = known.groupBy(*block).agg(F.count("*").alias("_n")).where(F.col("_n") <= FEW).select(*block)
    asked = stage(broken.where(F.col(wanted).isNotNull()).select(*block, wanted).distinct(), "wanted")
    few = asked.join(small, block, "left_semi")
    settled = few.join(known.select(*block, candidate), block).where(
        _closeness(F.col(wanted), F.col(candidate)) >= CUTOFF).select(*block, wanted, candidate).distinct()
    rest = stage(asked.join(small, block, "left_anti"), "rest-0")
    best = Window.partitionBy(*block, wanted).orderBy(F.desc("score"), candidate)
    names = stage(known.where(F.col(candidate).isNotNull()).select(*block, candidate).distinct().join(
        rest.select(*block).distinct(), block, "left_semi"), "names")
    n_names, longest = names.agg(F.count("*"), F.max(F.length(candidate))).first()
    if n_names:
        parts = -(-n_names // PART)
        names = stage(names.repartitionByRange(parts, *block, candidate).withColumn("_part", F.spark_partition_id()), "name-parts")
        places = stage(names.select(*block, "_part").distinct(), "places")
    k = 1
    while n_names:
        n_asked = rest.count()
        if k > edits and not n_asked:
            break
        slices = max(1, -(-n_asked // ASKED), min(-(-n_asked // 500), -(-4 * rest.sparkSession.sparkContext.defaultParallelism // parts)))
        near = _searched(rest, names, places, block, wanted, candidate, k, slices).withColumn("score", _closeness(F.col(wanted), F.col(candidate)))
        near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= SUGGESTIONS).select(*block, wanted, candidate, "score")
        near = stage(near, f"near-{k}")
        # No text with more than k edits scores higher than this.
        size = F.length(wanted)
        limit = 1 - F.lit(k + 1) / F.greatest(size, F.least(size + k + 1, F.lit(longest)))
        last = near.groupBy(*block, wanted).agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
        more = rest.join(last, [*block, wanted], "left").where(
            (limit >= CUTOFF - SLACK) & ((F.coalesce("_n", F.lit(0)) < SUGGESTIONS) | (F.col("_least") <= limit + SLACK)))
        rest = stage(more.select(*block, wanted), f"rest-{k}")
        settled = settled.unionByName(near.join(rest, [*block, wanted], "left_anti").select(*block, wanted, candidate))
        k = k + 1 if k < edits else k + max(1, k // 2)
    scored = settled.withColumn("score", _closeness(F.col(wanted), F.col(candidate)))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SUGGESTIONS)


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of each pair, the measure the reference results use."""
    import difflib

    def ratio(x: str, y: str) -> float:
        return difflib.SequenceMatcher(None, y, x).ratio()
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


@dataclass(frozen=True)
class Measure:
    """A similarity that shared letters bound from above.

    Two texts that reach ``CUTOFF`` share at least ``least`` of either one's letters; ``bound`` is the highest score that
    (shared letters, letters of one, letters of the other) allow.
    """

    least: float
    bound: Callable[[Column, Column, Column], Column]
    score: Callable[[Column, Column], Column]


#: One edit takes away at most one shared letter of the longer text.
EDITS = Measure(CUTOFF, lambda n, a, b: n / F.greatest(a, b), _closeness)
#: Matching blocks are shared letters, and a text's partner has at least 3/7 of its length.
MATCHING = Measure(CUTOFF / (2 - CUTOFF), lambda n, a, b: 2 * n / (a + b), lambda a, b: matching_ratio(a, b))
#: Pairs are compared in this order of their bounds.
BOUNDS = (0.9, 0.8, 0.7, CUTOFF)
SLACK = 1e-9


def _numbered(text: Column) -> Column:
    """The letters of a text, each with how often it has come so far: equal multisets have equal sets."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.array_sort(F.transform(letters, lambda x, i: F.concat(
        x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string"))))


def nearest_by_letters(asked: DataFrame, known: DataFrame, block: list[str], wanted: str, candidate: str, measure: Measure) -> DataFrame:
    """(block, wanted, candidate, score): at least the ``SUGGESTIONS`` best of every wanted text, exactly scored.

    Candidates with the same letters are one class, however many they are. Classes are indexed by their rarest letters,
    of which two texts that are near enough must share one; lengths, and then the number of shared letters, leave out
    more. The classes left are opened in descending order of the score they can reach at most, and not at all once
    a wanted text has enough candidates no other can beat.
    """
    asked = stage(asked.select(*block, wanted).distinct().withColumn("_a", _numbered(F.col(wanted))), "asked")
    texts = known.select(*block, candidate).distinct().withColumn("_b", _numbered(F.col(candidate)))
    texts = stage(texts.withColumn("_class", F.array_join("_b", "\x01")), "letters")
    classes = stage(texts.groupBy(*block, "_class").agg(F.first("_b").alias("_b")), "letter-classes")
    often = classes.select(*block, F.explode("_b").alias("_letter")).groupBy(*block, "_letter").agg(F.count("*").alias("_often"))

    def rare(df: DataFrame, key: str, letters: str, size: str) -> DataFrame:
        each = df.select(*block, key, F.size(letters).alias(size), F.explode(letters).alias("_letter"))
        order = Window.partitionBy(*block, key).orderBy(F.coalesce("_often", F.lit(0)), "_letter")
        ranked = each.join(often, [*block, "_letter"], "left").withColumn("_rank", F.row_number().over(order))
        return ranked.where(F.col("_rank") <= F.col(size) - F.ceil(F.col(size) * measure.least - SLACK) + 1).select(*block, "_letter", key, size)

    near_enough = (F.least("_n", "_m") >= F.greatest("_n", "_m") * measure.least - SLACK)
    # Letters are many more rows, and wider ones, than the compressed tables they come from: nothing here is broadcast.
    met = rare(asked, wanted, "_a", "_n").join(rare(classes, "_class", "_b", "_m").hint("merge"), [*block, "_letter"]).where(near_enough).select(
        *block, wanted, "_class").distinct()
    both = met.join(asked.hint("merge"), [*block, wanted]).join(classes.hint("merge"), [*block, "_class"])
    bound = measure.bound(F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b"))
    pairs = stage(both.withColumn("_bound", bound).where(F.col("_bound") >= CUTOFF - SLACK).select(*block, wanted, "_class", "_bound"), "letter-pairs")

    members = texts.select(*block, "_class", candidate)
    open_ones, found, above = asked.select(*block, wanted), None, 2.0
    for least in BOUNDS:
        now = pairs.where((F.col("_bound") >= least - SLACK) & (F.col("_bound") < above)).join(open_ones, [*block, wanted], "left_semi")
        scored = now.join(members.hint("merge"), [*block, "_class"]).withColumn("score", measure.score(F.col(wanted), F.col(candidate)))
        scored = stage(scored.where(F.col("score") >= CUTOFF).select(*block, wanted, candidate, "score"), "scored")
        found = scored if found is None else found.unionByName(scored)
        # What is not compared yet stays below ``least``, so texts at or above it are settled.
        settled = found.where(F.col("score") >= least).groupBy(*block, wanted).agg(F.count("*").alias("_k")).where(F.col("_k") >= SUGGESTIONS)
        open_ones = stage(open_ones.join(settled, [*block, wanted], "left_anti"), "open")
        above = least - SLACK
    return found


def closest_by_matching(broken: DataFrame, known: DataFrame, block: list[str], wanted: str,
                        candidate: str) -> DataFrame:
    """As :func:`closest`, scored by matching blocks, for exact agreement; ties go to the later name."""
    scored = nearest_by_letters(broken, known, block, wanted, candidate, MATCHING)
    best = Window.partitionBy(*block, wanted).orderBy(F.desc("score"), F.desc(candidate))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SUGGESTIONS)


def plan_repairs(refs: DataFrame, sessions: DataFrame, files: DataFrame, match=closest) -> DataFrame:
    """Suggestions for local references that name nothing.

    ``refs``: archive, run_id, filename, ref_session, ref_file, all local. An
    unknown session gets near session ids, those holding the file first choice; a
    known session without the file gets near file names. Only references that
    fail are offered.
    """
    named = refs.withColumn("to_session", F.coalesce("ref_session", "run_id"))
    known = sessions.select("archive", F.col("run_id").alias("to_session"))
    lost = stage(named.join(known, ["archive", "to_session"], "left_anti"), "lost-sessions")
    have = files.select("archive", F.col("run_id").alias("to_session"), F.col("name").alias("ref_file"))
    missing = named.where("ref_file is not null").join(known, ["archive", "to_session"], "left_semi").join(
        have, ["archive", "to_session", "ref_file"], "left_anti")
    missing = stage(missing, "lost-files")

    ids_near = match(lost.select("archive", "to_session"), sessions.select("archive", F.col("run_id").alias("near_id")),
                     ["archive"], "to_session", "near_id").select("archive", "to_session", "near_id", "score", "place")
    offered = lost.join(ids_near, ["archive", "to_session"], "left")
    holds = files.select("archive", F.col("run_id").alias("near_id"), F.col("name").alias("ref_file"),
                         F.lit(True).alias("_holds"))
    offered = offered.join(holds, ["archive", "near_id", "ref_file"], "left")
    key = ["archive", "run_id", "filename", "ref_session", "ref_file"]
    some = offered.groupBy(*key).agg(F.bool_or("_holds").alias("_some"))
    on = [F.col("o." + k).eqNullSafe(F.col("s." + k)) for k in key]
    offered = (offered.alias("o").join(some.alias("s"), on).where(
        F.col("o._holds") | ~F.coalesce("s._some", F.lit(False)))
        .select(*["o." + k for k in key], F.lit("no such session").alias("problem"),
                F.col("o.near_id").alias("fixed_session"), F.col("o.ref_file").alias("fixed_file"), F.col("o.place")))

    names_near = match(missing.select("archive", "to_session", "ref_file"),
                       files.select("archive", F.col("run_id").alias("to_session"), F.col("name").alias("near_file")),
                       ["archive", "to_session"], "ref_file", "near_file")
    near = missing.join(names_near.select("archive", "to_session", "ref_file", "near_file", "place"),
                        ["archive", "to_session", "ref_file"], "left").select(
        *key, F.lit("no such file in that session").alias("problem"),
        F.col("ref_session").alias("fixed_session"), F.col("near_file").alias("fixed_file"), "place")
    return offered.unionByName(near)


def accept_unambiguous(repairs: DataFrame) -> DataFrame:
    """Repairs with exactly one suggestion (T8); any other needs a person."""
    key = ["run_id", "filename", "ref_session", "ref_file"]
    return repairs.where("place is not null").groupBy("archive", *key).agg(
        F.count("*").alias("n"), F.min("fixed_session").alias("fixed_session"), F.min("fixed_file").alias("fixed_file")
    ).where("n = 1").drop("n")


# -- U5, G5, T1-T4: exports ---------------------------------------------------------------

def expand_selection(sessions: DataFrame | None, refs: DataFrame | None) -> DataFrame:
    """A selection as (archive, run_id, filename); a null name is the whole session.

    ``refs`` may come from people or from collection entries; those without a
    session are dropped. A whole session takes in any of its files (U5).
    """
    rows = None
    if sessions is not None:
        rows = sessions.select(*SESSION, F.lit(None).cast("string").alias("filename"))
    if refs is not None:
        named = refs.where("ref_session is not null").select(
            "archive", F.col("ref_session").alias("run_id"), F.col("ref_file").alias("filename"))
        rows = named if rows is None else rows.unionByName(named)
    rows = rows.distinct()
    whole = rows.where("filename is null").select(*SESSION)
    return rows.where("filename is not null").join(whole, SESSION, "left_anti").unionByName(
        whole.withColumn("filename", F.lit(None).cast("string")))


def export_requests(requests: DataFrame, picked: DataFrame, archives: DataFrame) -> DataFrame:
    """Which exports are not made at all, and why.

    ``requests`` has (archive, request), ``picked`` the same with the sessions each
    takes, one row or more. Ids of an intake archive are provisional, so nothing
    cut from one could be cited; an unknown archive and an empty selection are
    refused as well. ``refused`` is null where the export may go on.
    """
    asked = requests.select("archive", "request").distinct()
    some = picked.where("run_id is not null").groupBy("archive", "request").agg(F.count_distinct("run_id").alias("n_sessions"))
    kinds = archives.groupBy("archive").agg(F.max("kind").alias("_kind"))
    got = asked.join(some, ["archive", "request"], "left").join(kinds, "archive", "left")
    refused = (F.when(F.col("_kind").isNull(), "unknown archive").when(F.col("_kind") == "intake", "intake ids are provisional, merge first")
               .when(F.col("n_sessions").isNull(), "empty selection"))
    return got.select("archive", "request", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), refused.alias("refused"))


def in_archives_of(rows: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """What of each table lies in the archives of ``rows``; their list is written, so that Spark knows how short it is."""
    here = stage(rows.select("archive").distinct(), "archives-of")
    return [t.join(here, "archive", "left_semi") for t in tables]


def selection_closure(picked: DataFrame, files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A selection with everything it was derived from, and references elsewhere.

    The walk keeps one set for the whole selection, linear in what it reaches. A
    whole-session reference brings in a session not yet selected, is not followed
    further, and never widens a subset somebody chose. References to other archives
    are not followed, so only edges of the selection's own archives are dealt out.
    """
    picked = stage(picked, "picked")
    files, edges = in_archives_of(picked, files, edges)
    whole = picked.where("filename is null").select(*SESSION)
    chosen = picked.where("filename is not null")
    start = chosen.unionByName(files.join(whole, SESSION, "left_semi").select(
        *SESSION, F.col("name").alias("filename")))
    local = edges.where("ref_asset is null and ref_collection is null").withColumn(
        "to_session", F.coalesce("ref_session", "run_id"))
    home = F.col("ref_archive").isNull() | (F.col("ref_archive") == F.col("archive"))
    inner = local.where(home)
    links = inner.where("ref_file is not null").select(*NODE, F.col("to_session").alias("p_run_id"),
                                                     F.col("ref_file").alias("p_filename"))
    reached = walk(start, links, [], NODE, NODE, ["archive", "p_run_id", "p_filename"])
    nodes = stage(start.unionByName(reached.select(*NODE)).distinct(), "closure")
    named_whole = (inner.where("ref_file is null").join(nodes, NODE, "left_semi")
                   .select("archive", F.col("to_session").alias("run_id")).distinct()
                   .join(chosen.select(*SESSION), SESSION, "left_anti"))
    all_whole = whole.unionByName(named_whole).distinct()
    closed = nodes.join(all_whole, SESSION, "left_anti").unionByName(
        all_whole.withColumn("filename", F.lit(None).cast("string")))
    foreign = local.where(~home).join(nodes, NODE, "left_semi").select(
        *NODE, "ref_user", "ref_archive", F.col("ref_session"), "ref_file")
    return closed, foreign


def wanted_files(closed: DataFrame, files: DataFrame) -> DataFrame:
    """Every file a closed selection names, there or not (``size`` null if not)."""
    whole = closed.where("filename is null").select(*SESSION)
    everything = files.join(whole, SESSION, "left_semi").select(*ITEM, "size", "sha256")
    listed = closed.where("filename is not null").withColumnRenamed("filename", "name").join(
        files.select(*ITEM, "size", "sha256"), ITEM, "left")
    return everything.unionByName(listed.select(*ITEM, "size", "sha256"))


def plan_export(closed: DataFrame, sessions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per session what an export takes, and what it cannot find."""
    named = closed.select(*SESSION).distinct()
    there = named.join(sessions.select(*SESSION), SESSION, "left_semi")
    gone = named.join(sessions.select(*SESSION), SESSION, "left_anti").select(
        *SESSION, F.lit(None).cast("string").alias("name"), F.lit("session not found").alias("note"))
    want = wanted_files(closed, files).join(sessions.select(*SESSION), SESSION, "left_semi")
    missing = want.where("size is null").select(*ITEM, F.lit("file is missing").alias("note"))
    taken = session_bytes(want.where("size is not null"))
    whole = files.groupBy(*SESSION).agg(F.count("*").alias("all_files"))
    zero = F.lit(0).cast("bigint")
    plan = there.join(taken, SESSION, "left").join(whole, SESSION, "left").select(
        *SESSION, F.coalesce("n_files", zero).alias("n_files"), F.coalesce("bytes", zero).alias("bytes"),
        (F.coalesce("n_files", zero) < F.coalesce("all_files", zero)).alias("partial"),
        (F.coalesce("all_files", zero) - F.coalesce("n_files", zero)).alias("omitted"), F.lit(False).alias("foreign"))
    return plan, gone.unionByName(missing)


def plan_foreign(foreign: DataFrame, archives: DataFrame, sessions: DataFrame,
                 files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions of other archives an export embeds, and references it cannot."""
    asked = foreign.select(F.col("ref_archive").alias("archive"), F.col("ref_session").alias("run_id"),
                           F.col("ref_file").alias("filename")).distinct()
    held = sessions.join(archives.where("reachable").select("archive"), "archive", "left_semi").select(*SESSION)
    plan, _missing = plan_export(expand_selection(None, asked.select(
        "archive", F.col("run_id").alias("ref_session"), F.col("filename").alias("ref_file"))).join(
        held, SESSION, "left_semi"), sessions, files)
    lost = foreign.join(held.select(F.col("archive").alias("ref_archive"), F.col("run_id").alias("ref_session")),
                        ["ref_archive", "ref_session"], "left_anti")
    return plan.withColumn("foreign", F.lit(True)), lost


def manifests_for(want: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Code manifests behind the wanted files."""
    return (sidecars.where("code is not null and not trashed").withColumnRenamed("filename", "name")
            .join(want.select(*ITEM), ITEM, "left_semi").select(F.col("code").alias("manifest")).distinct())


def export_collections(entries: DataFrame, plan: DataFrame, want: DataFrame) -> DataFrame:
    """Entries of collections that still point at something exported (T4).

    ``entries`` is parsed. Nested collections stay; an entry of another archive
    or of something left out goes. Adds how many entries were dropped; a
    collection nothing is left of does not appear.
    """
    local = entries.where("ref_error is null").withColumn(
        "_home", F.coalesce("ref_archive", "archive") == F.col("archive"))
    by_session = plan.select("archive", F.col("run_id").alias("ref_session"), F.lit(True).alias("_s"))
    by_file = want.where("size is not null").select(
        "archive", F.col("run_id").alias("ref_session"), F.col("name").alias("ref_file"), F.lit(True).alias("_f"))
    judged = local.join(by_session, ["archive", "ref_session"], "left").join(
        by_file, ["archive", "ref_session", "ref_file"], "left")
    keep = F.col("ref_collection").isNotNull() | (F.col("_home") & F.when(
        F.col("ref_file").isNull(), F.col("_s")).otherwise(F.col("_f")))
    judged = judged.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    dropped = judged.groupBy("archive", "collection").agg(F.count_if(~F.col("_keep")).alias("dropped"))
    return judged.where("_keep").select("archive", "collection", "ord", "ref").join(
        dropped, ["archive", "collection"])


# -- T11, T15, U4, T16 ------------------------------------------------------------------

def blob_transfer(manifests: DataFrame, manifest_files: DataFrame, source: DataFrame,
                  dest: DataFrame) -> DataFrame:
    """Blobs a move needs: present already, to copy, or missing."""
    needed = manifest_files.join(manifests, "manifest", "left_semi").select(F.col("blob").alias("digest")).distinct()
    here = dest.select("digest", F.lit(True).alias("_here")).distinct()
    there = source.select("digest", "bytes", F.lit(True).alias("_there")).dropDuplicates(["digest"])
    return needed.join(here, "digest", "left").join(there, "digest", "left").select(
        "digest", F.when(F.col("_here"), "present").when(F.col("_there"), "copy").otherwise("missing").alias("action"),
        "bytes")


def receive_routing(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """Where incoming rows are filed: by owner and archive, not by sender."""
    owned = archives.select("archive", "kind", F.when(F.coalesce("owner", F.lit("")) == "", "unknown")
                            .otherwise(F.col("owner")).alias("owner"))
    return rows.join(owned, "archive").withColumn(
        "refused", F.when(F.col("kind") != "fragment", F.concat(F.lit("not a fragment but "), F.col("kind")))
    ).withColumn("destination", F.concat_ws("/", "owner", "archive"))


def receive(incoming: DataFrame, incoming_files: DataFrame, existing: DataFrame, existing_files: DataFrame,
            overwrite: bool = False) -> DataFrame:
    """What happens to each incoming session: added, skipped or in conflict (U4).

    Identical copies are skipped. A differing one is kept as it is and reported,
    unless told to overwrite. A session without files counts as new.
    """
    known = existing.select(*SESSION, F.lit(True).alias("_known"))
    compared = compare_copies(incoming_files, existing_files)
    zero = F.lit(0).cast("bigint")
    got = incoming.select(*SESSION).join(known, SESSION, "left").join(compared, SESSION, "left").withColumns(
        {"same": F.coalesce("same", zero), "differing": F.coalesce("differing", zero)})
    action = (F.when(F.col("_known").isNull(), "add")
              .when(F.col("differing") > 0, "overwrite" if overwrite else "conflict")
              .when(F.col("same") > 0, "skip").otherwise("add"))
    return got.select(*SESSION, "same", "differing", action.alias("action"))


def union_tables(existing: DataFrame, incoming: DataFrame, actions: DataFrame) -> DataFrame:
    """The table after receiving: winners of both sides."""
    taken = actions.where("action in ('add', 'overwrite')").select(*SESSION)
    kept = existing.join(taken, SESSION, "left_anti")
    return kept.unionByName(incoming.join(taken, SESSION, "left_semi"), allowMissingColumns=True)


def apply_merge(plan: DataFrame, source_sessions: DataFrame, dest_sessions: DataFrame, source: str, dest: str,
                at: str, op: str = "merge") -> tuple[DataFrame, DataFrame]:
    """Both session tables after a merge or an adoption.

    Moved sessions appear at the destination under their new ids with a note of
    where they came from. A merge also marks the source, which is what makes
    running it again change nothing; an adoption leaves the source as it is.
    """
    ids_of = plan.select(*SESSION, "new_run_id", *(["origin"] if op == "adopt" else []))
    action = "merged" if op == "merge" else "adopted"
    note = (F.concat(F.lit(f"{op} from {source}/"), F.col("run_id")) if op == "merge"
            else F.concat(F.lit("adopted from "), F.col("origin")))
    moved = source_sessions.join(ids_of, SESSION).withColumn(
        "history", F.array_append("history", history_entry(action, F.lit(at), note))
    ).withColumns({"archive": F.lit(dest), "run_id": F.col("new_run_id")}).drop("new_run_id", "origin")
    arrived = dest_sessions.unionByName(moved.select(*dest_sessions.columns))
    if op != "merge":
        return arrived, source_sessions
    marks = plan.select(*SESSION, F.concat(F.lit(f"{dest}|"), F.col("new_run_id")).alias("note"))
    return arrived, stamp_history(source_sessions, marks, "merged", at)


def unsealed(plan: DataFrame, seals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions of a plan that sealed years do not refuse, and those they do.

    ``seals`` holds the destination's sealed years, read as the ids' years are.
    """
    years = seals.select(F.col("year").alias("id_year")).distinct()
    return (plan.join(years, "id_year", "left_anti"),
            plan.join(years, "id_year", "left_semi").withColumn("refused", F.lit("sealed year")))


#: Tables of references: rows change their own session and what they refer to.
REFERRING = ("edges", "related_runs")


def merge_tables(plan: DataFrame, tables: dict[str, DataFrame], dest: str,
                 repairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The destination's tables after the planned sessions have moved in.

    ``tables`` holds, by name, tables of all archives whose rows belong to a
    session: files, sidecars, annotations, renames, edges, related_runs. Rows of
    the destination stay, rows of planned sessions follow under the new ids.
    """
    ids_of = plan.select(*SESSION, "new_run_id")
    out = {}
    for name, table in tables.items():
        mine = table.join(ids_of, SESSION)
        if name in REFERRING:
            moved = rewrite_refs(mine.drop("new_run_id"), plan.select("run_id", "new_run_id"), dest,
                                 repairs if name == "edges" else None)
        else:
            moved = mine.withColumns({"archive": F.lit(dest), "run_id": F.col("new_run_id")})
        out[name] = table.where(F.col("archive") == dest).unionByName(moved.select(*table.columns))
    return out


def merge_entries(entries: DataFrame, plan: DataFrame, source: str, dest: str) -> tuple[DataFrame, DataFrame]:
    """The destination's collection entries after a merge, and the source's entries left behind.

    ``entries`` is parsed. Incoming collections whose name is taken get a name of
    their own; malformed entries of the source do not move.
    """
    mine, theirs = entries.where(F.col("archive") == source), entries.where(F.col("archive") == dest)
    names = carry_collections(mine, theirs, source)
    columns = ["archive", "collection", "ord", "ref", "note"]
    moved = remap_entries(mine, plan, names, dest).select(
        F.lit(dest).alias("archive"), F.col("new_name").alias("collection"), "ord", F.col("new_ref").alias("ref"), "note")
    return theirs.select(*columns).unionByName(moved), mine.where("ref_error is not null").select(*columns, "ref_error")


def merge_code(plan: DataFrame, sidecars: DataFrame, manifests: DataFrame, manifest_files: DataFrame, blobs: DataFrame,
               dest_manifests: DataFrame, dest_blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The destination's manifests after a merge, and what becomes of their blobs.

    Manifests that files of moved sessions claim arrive unless the destination's
    store holds them already; one that the source's store lacks is missing. Each
    blob of the manifests that arrive is present, to copy, or missing.
    """
    here = dest_manifests.select("manifest").distinct()
    claimed = sidecars.where("code is not null and not trashed").select(*SESSION, F.col("code").alias("manifest"))
    arriving = claimed.join(plan.select(*SESSION), SESSION, "left_semi").select("manifest").distinct().join(here, "manifest", "left_anti")
    known = here.withColumn("arrived", F.lit(False)).unionByName(arriving.withColumn("arrived", F.lit(True)))
    after = known.join(manifests, "manifest", "left").withColumn("missing", F.col("entry").isNull())
    return after, blob_transfer(arriving, manifest_files, blobs, dest_blobs)


def merge_catalog(plan: DataFrame, seals: DataFrame, tables: dict[str, DataFrame], source: str, dest: str, at: str,
                  repairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """A whole merge: every table of the destination, and the source's, as they are afterwards.

    Sessions of years that are sealed at the destination are refused first; all
    else follows the sessions that are free to move, so nothing of a refused one
    arrives, nor is it marked, and the source is locked only if none is refused.
    ``tables`` holds sessions (with their history), archives, collection_entries
    (parsed) and any of the tables of :func:`merge_tables`.
    """
    free, refused = unsealed(plan, seals)
    free, refused = stage(free, "merge-free"), stage(refused, "merge-refused")
    sessions, archives, entries = (tables[n] for n in ("sessions", "archives", "collection_entries"))
    mine, theirs = sessions.where(F.col("archive") == source), sessions.where(F.col("archive") == dest)
    arrived, marked = apply_merge(free, mine, theirs, source, dest, at)
    rest = {n: t for n, t in tables.items() if n not in ("sessions", "archives", "collection_entries")}
    out = merge_tables(free, rest, dest, repairs)
    out["collection_entries"], out["entries_left"] = merge_entries(entries, free, source, dest)
    locks = not free.isEmpty() and refused.isEmpty()
    out["archives"] = lock_archive(archives, source, dest, at) if locks else archives
    return out | {"sessions": arrived, "source_sessions": marked, "refused": refused, "plan": free}


def lock_archive(archives: DataFrame, source: str, dest: str, at: str) -> DataFrame:
    """Refuse further writes to a merged archive."""
    mine = F.col("archive") == source
    out = archives.withColumn("merged_at", F.when(mine, at).otherwise(F.col("merged_at")))
    return out.withColumn("merged_to", F.when(mine, dest).otherwise(
        F.col("merged_to") if "merged_to" in archives.columns else F.lit(None).cast("string")))
