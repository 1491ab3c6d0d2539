"""Exports, merges and adoptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import refs as rf
from tracelake.functions.refs import parse_refs
from tracelake.operators import transfer as tr
from tracelake.operators.items import SESSION
from tracelake.plans.audit import ENTRIES
from tracelake.plans.registry import NOW, THIS_YEAR, query
from tracelake.plans.store import seals_of

SRC, DEST, OWNER, SCHEME = "ASIA", "EUROPE", "middle-east@example.org", "prov://"
NO = "cast(null as string)"


# -- W2, W3 -----------------------------------------------------------------------

def batch_of(cat):
    """A second delivery of every file with a sidecar, by the name asked for."""
    return cat.artifacts.where("has_sidecar").select(
        "archive", "run_id", F.col("display_name").alias("requested"), "created", "partkey", "suppkey", "filename").withColumnRenamed(
        "filename", "delivered")


BATCH = """batch as (select archive, run_id, display_name as requested, created, partkey, suppkey, filename as delivered from @artifacts where has_sidecar)"""
ORDER = ["created", "partkey", "suppkey", "delivered"]


@query("w02_names_duplicate", f"""with recursive {BATCH}, known as (select archive, run_id, name from @files union select archive, run_id, requested from batch),
ranked as (select b.*, f.name is not null as taken, row_number() over (partition by b.archive, b.run_id, requested order by created, partkey, suppkey, delivered) as nth
  from batch b left join @files f on b.archive = f.archive and b.run_id = f.run_id and b.requested = f.name),
want as (select *, nth - 1 + case when taken then 1 else 0 end as n from ranked),
size as (select archive, run_id, requested, max(n) + 20 as top from want group by 1, 2, 3),
slots as (select archive, run_id, requested, unnest(range(1, top + 1)) as k from size),
free as (select s.*, row_number() over (partition by s.archive, s.run_id, s.requested order by k) as n from slots s anti join known f
  on s.archive = f.archive and s.run_id = f.run_id and split_part(requested, '.', 1) || '-' || lpad(cast(k as string), 3, '0') || '.' || split_part(requested, '.', 2) = f.name)
select w.archive, w.run_id, w.requested, delivered, cast(k as integer) as duplicate_index,
  case when k is null then w.requested else split_part(w.requested, '.', 1) || '-' || lpad(cast(k as string), 3, '0') || '.' || split_part(w.requested, '.', 2) end as filename
from want w left join free f on w.archive = f.archive and w.run_id = f.run_id and w.requested = f.requested and w.n = f.n""")
def names_duplicate(cat):
    """Every file delivered again: names next to the ones already there."""
    got = tr.resolve_names(batch_of(cat), cat.files, ORDER, F.substring("created", 1, 10))
    return got.select("archive", "run_id", "requested", "delivered", "duplicate_index", "filename")


@query("w02_names_overwrite", f"""with {BATCH}, r as (select *, row_number() over (partition by archive, run_id, requested order by created desc, partkey desc, suppkey desc, delivered desc) as back from batch)
select archive, run_id, requested, delivered from r where back = 1""")
def names_overwrite(cat):
    return tr.resolve_names(batch_of(cat), cat.files, ORDER, F.substring("created", 1, 10), "overwrite").select(
        "archive", "run_id", "requested", "delivered")


@query("w02_names_cancel", f"""with {BATCH}, r as (select b.*, f.name is not null as taken, row_number() over (partition by b.archive, b.run_id, requested order by created, partkey, suppkey, delivered) as nth
  from batch b left join @files f on b.archive = f.archive and b.run_id = f.run_id and b.requested = f.name)
select archive, run_id, requested, delivered, case when taken or nth > 1 then 'name already taken' end as refused from r""")
def names_cancel(cat):
    return tr.resolve_names(batch_of(cat), cat.files, ORDER, F.substring("created", 1, 10), "cancel").select(
        "archive", "run_id", "requested", "delivered", "refused")


def new_ids_sql(source: str, name: str, dest: str = DEST) -> str:
    return f"""{name} as (select m.*, 'S-' || substr(run_id, 3, 2) || '-' || lpad(cast(n as string), greatest(4, length(cast(n as string)))::int, '0') as new_run_id
  from (select i.*, cast(2000 + cast(substr(run_id, 3, 2) as integer) as integer) as id_year,
      coalesce(top, 0) + row_number() over (partition by substr(run_id, 3, 2) order by cast(substr(run_id, 6) as bigint), run_id) as n
    from {source} i left join (select substr(run_id, 3, 2) as yy, max(cast(substr(run_id, 6) as bigint)) as top from @session_rows where archive = '{dest}' group by 1) t
      on substr(i.run_id, 3, 2) = t.yy) m)"""


@query("w03_id_allocation", f"with src as (select archive, run_id from @session_rows where archive <> '{DEST}'), {new_ids_sql('src', 'alloc')} select archive, run_id, new_run_id from alloc")
def id_allocation(cat):
    """New ids at one archive for every session of the others."""
    incoming = cat.session_rows.where(f"archive <> '{DEST}'").select(*SESSION)
    existing = cat.session_rows.where(f"archive = '{DEST}'").select("run_id")
    return tr.next_ids(incoming, existing).select("archive", "run_id", "new_run_id")


# -- the merge of the intake archive -------------------------------------------------

MERGE = f"""judged as (select archive, run_id, status, case when merged_note is not null then 'already merged as ' || merged_note when status = 'open' then 'still open' end as note
  from @sessions where archive = '{SRC}'),
todo as (select archive, run_id from judged where note is null), {new_ids_sql('todo', 'moved')},
sized as (select archive, run_id, count(*) as n_files, cast(sum(size) as bigint) as bytes from @files group by 1, 2),
plan as (select m.archive, m.run_id, id_year, new_run_id, coalesce(n_files, 0) as n_files, coalesce(bytes, 0) as bytes from moved m left join sized s on m.archive = s.archive and m.run_id = s.run_id)"""


def merge_of(cat):
    source = tr.history_of(cat).where(f"archive = '{SRC}'")
    unreadable = cat.session_rows.where(f"archive = '{SRC}' and record_state = 'unreadable'").select(*SESSION)
    dest = cat.session_rows.where(f"archive = '{DEST}'").select("run_id")
    plan, skipped = tr.plan_merge(source, unreadable, cat.files, dest, THIS_YEAR)
    return cat.shared("merge-plan", lambda: plan), skipped


@query("t05_merge_plan", f"with {MERGE} select * from plan")
def merge_plan(cat):
    return merge_of(cat)[0]


@query("t05_merge_skipped", f"""with {MERGE} select archive, run_id, note from judged where note is not null
union all select archive, run_id, 'unreadable record' from @session_rows where archive = '{SRC}' and record_state = 'unreadable'""")
def merge_skipped(cat):
    return merge_of(cat)[1]


@query("a13_plan_totals", f"with {MERGE} select count(*) as n_sessions, cast(sum(n_files) as bigint) as n_files, cast(sum(bytes) as bigint) as bytes, cast(0 as bigint) as foreign_bytes, count(*) as n_renamed from plan")
def plan_totals(cat):
    return tr.plan_totals(merge_of(cat)[0])


@query("t12_sealed_conflicts", f"""with {MERGE} select id_year as year, count(*) as n_sessions from plan where id_year - 100 in (select year from @session_rows where archive = '{DEST}' and year <= 1997) group by 1""")
def sealed_conflicts(cat):
    """Two-digit years read as 20yy, so seals are matched by that reading."""
    seals = seals_of(cat).where(f"archive = '{DEST}'").select((F.col("year") + 100).alias("year"))
    return tr.sealed_conflicts(merge_of(cat)[0], seals)


# -- repairs ---------------------------------------------------------------------------

def local_refs(cat):
    """References a merge would review: of moved sessions, into their own archive."""
    plan = merge_of(cat)[0].select(*SESSION)
    edges = cat.edges.where("ref_archive is null and ref_asset is null").select(
        "archive", "run_id", "filename", "ref_session", "ref_file")
    runs = cat.related_runs.where("ref_archive is null").select(
        "archive", "run_id", F.lit(None).cast("string").alias("filename"), "ref_session", "ref_file")
    return edges.unionByName(runs).join(plan, SESSION, "left_semi")


def repairs_of(cat):
    known = cat.sessions.where(f"archive = '{SRC}'")
    files = cat.files.join(known.select(*SESSION), SESSION, "left_semi")
    return cat.shared("repairs", lambda: tr.plan_repairs(local_refs(cat), known, files))


REPAIRS = MERGE + f""", lrefs as (select e.archive, e.run_id, e.filename, e.ref_session, e.ref_file, coalesce(ref_session, e.run_id) as ts from @edges e semi join plan p on e.archive = p.archive and e.run_id = p.run_id
    where ref_archive is null and ref_asset is null
  union all select r.archive, r.run_id, {NO}, r.ref_session, {NO}, r.ref_session from @related_runs r semi join plan p on r.archive = p.archive and r.run_id = p.run_id where ref_archive is null),
known as (select archive, run_id from @sessions where archive = '{SRC}'),
kfiles as (select f.* from @files f semi join known k on f.archive = k.archive and f.run_id = k.run_id),
lost as (select l.* from lrefs l anti join known k on l.archive = k.archive and l.ts = k.run_id),
near as (select * from (select w.ts, k.run_id as c, row_number() over (partition by w.ts order by 1 - levenshtein(w.ts, k.run_id) / greatest(length(w.ts), length(k.run_id)) desc, k.run_id) as place
  from (select distinct ts from lost) w, known k where 1 - levenshtein(w.ts, k.run_id) / greatest(length(w.ts), length(k.run_id)) >= 0.6) n where place <= 3),
offered as (select l.archive, l.run_id, l.filename, l.ref_session, l.ref_file, n.c, n.place, f.name is not null as holds from lost l left join near n on l.ts = n.ts
  left join kfiles f on n.c = f.run_id and l.ref_file = f.name),
kept as (select *, max(holds) over (partition by archive, run_id, filename, ref_session, ref_file) as any_holds from offered),
missing as (select l.* from lrefs l semi join known k on l.archive = k.archive and l.ts = k.run_id anti join kfiles f on l.archive = f.archive and l.ts = f.run_id and l.ref_file = f.name where ref_file is not null),
fnear as (select * from (select w.ts, w.ref_file, f.name as c, row_number() over (partition by w.ts, w.ref_file order by 1 - levenshtein(w.ref_file, f.name) / greatest(length(w.ref_file), length(f.name)) desc, f.name) as place
  from (select distinct ts, ref_file from missing) w join kfiles f on w.ts = f.run_id where 1 - levenshtein(w.ref_file, f.name) / greatest(length(w.ref_file), length(f.name)) >= 0.6) n where place <= 3),
repairs as (select archive, run_id, filename, ref_session, ref_file, 'no such session' as problem, c as fixed_session, ref_file as fixed_file, place from kept where holds or not any_holds
  union all select m.archive, m.run_id, m.filename, m.ref_session, m.ref_file, 'no such file in that session', m.ref_session, n.c, n.place from missing m left join fnear n on m.ts = n.ts and m.ref_file = n.ref_file),
accepted as (select archive, run_id, filename, ref_session, ref_file, min(fixed_session) as fixed_session, min(fixed_file) as fixed_file from repairs where place is not null
  group by 1, 2, 3, 4, 5 having count(*) = 1)"""


@query("j14_repair_candidates", f"with {REPAIRS} select archive, run_id, filename, ref_session, ref_file, problem, fixed_session, fixed_file, cast(place as integer) as place from repairs")
def repair_candidates(cat):
    return repairs_of(cat).withColumn("place", F.col("place").cast("int"))


# Names with a letter out, with another start, or with other digits, in one archive that holds them all.
CLOSEST = """known as (select distinct c_name as candidate from customer),
asked as (select distinct case c_custkey % 30 when 0 then 'Custmer#' || substr(c_name, 10) || 'x' when 10 then 'Kunde-' || substr(c_name, 12) else substr(c_name, 1, 12) || '9x7' || substr(c_name, 16) end as wanted
  from customer where c_custkey % 10 = 0),
scored as (select wanted, candidate, 1 - levenshtein(wanted, candidate) / greatest(length(wanted), length(candidate)) as score from asked, known),
best as (select *, row_number() over (partition by wanted order by score desc, candidate) as place from scored where score >= 0.6)"""


@query("j14_closest_names", f"with {CLOSEST} select wanted, candidate, cast(place as integer) as place from best where place <= 3")
def closest_names(cat):
    """The three nearest of all customers' names to names that are not quite theirs."""
    one, name, kind = F.lit("all").alias("archive"), F.col("c_name"), F.col("c_custkey") % 30
    asked = cat.customer.where("c_custkey % 10 = 0").select(one, F.when(kind == 0, F.concat(F.lit("Custmer#"), F.substring(name, 10, 99), F.lit("x")))
        .when(kind == 10, F.concat(F.lit("Kunde-"), F.substring(name, 12, 99)))
        .otherwise(F.concat(F.substring(name, 1, 12), F.lit("9x7"), F.substring(name, 16, 99))).alias("wanted"))
    got = tr.closest(asked, cat.customer.select(one, name.alias("candidate")), ["archive"], "wanted", "candidate")
    return got.select("wanted", "candidate", F.col("place").cast("int").alias("place"))


@query("t08_accepted_repairs", f"with {REPAIRS} select * from accepted")
def accepted_repairs(cat):
    return tr.accept_unambiguous(repairs_of(cat))


@query("t06_rewritten_refs", f"""with {REPAIRS},
fixed as (select e.run_id, e.filename, e.ord, e.ref_archive, e.ref_asset, e.ref_sha256, case when a.run_id is not null then a.fixed_session else e.ref_session end as s,
    case when a.run_id is not null then a.fixed_file else e.ref_file end as f
  from @edges e left join accepted a on e.ref_archive is null and e.run_id = a.run_id and e.filename is not distinct from a.filename and e.ref_session is not distinct from a.ref_session
    and e.ref_file is not distinct from a.ref_file where e.archive = '{SRC}')
select h.new_run_id as run_id, x.filename, x.ord, case when ref_archive <> '{DEST}' then ref_archive end as ref_archive,
  case when coalesce(ref_archive, '{DEST}') = '{DEST}' then coalesce(t.new_run_id, s) else s end as ref_session, f as ref_file, ref_asset, ref_sha256
from fixed x join plan h on x.run_id = h.run_id left join plan t on x.s = t.run_id""")
def rewritten_refs(cat):
    """References of the merged sessions as they read afterwards."""
    plan = merge_of(cat)[0]
    got = tr.rewrite_refs(cat.edges.where(f"archive = '{SRC}'"), plan, DEST, tr.accept_unambiguous(repairs_of(cat)))
    return got.select("run_id", "filename", "ord", "ref_archive", "ref_session", "ref_file", "ref_asset", "ref_sha256")


def entries_of(cat):
    return rf.parse_refs(cat.collection_entries, "ref")


NAMES = f"""cnames as (select collection, case when collection in (select collection from @collection_entries where archive = '{DEST}')
    then replace(collection, '#', '#') || '-{SRC}' else collection end as new_name from (select distinct collection from @collection_entries where archive = '{SRC}') c)"""


@query("t07_collection_names", f"with {NAMES} select collection, new_name, collection <> new_name as renamed from cnames")
def collection_names(cat):
    entries = cat.collection_entries
    return tr.carry_collections(entries.where(f"archive = '{SRC}'"), entries.where(f"archive = '{DEST}'"), SRC)


@query("t07_remapped_entries", f"""with {MERGE}, {NAMES}, e as (select *, regexp_extract(ref, '([SI]-[0-9]+-[0-9]+)', 1) as ses from @collection_entries where archive = '{SRC}' and ref <> 'a|b|c')
select e.collection, n.new_name, e.ord, e.ref, case when ref like 'prov://%' or ref like '{SRC}|%' then ref when p.new_run_id is not null then replace(ref, ses, new_run_id)
  when ref like 'collections/%' then 'collections/' || coalesce(k.new_name, replace(ref, 'collections/', '')) else ref end as new_ref, note
from e join cnames n on e.collection = n.collection left join plan p on e.ses = p.run_id left join cnames k on replace(ref, 'collections/', '') = k.collection""")
def remapped_entries(cat):
    names = tr.carry_collections(cat.collection_entries.where(f"archive = '{SRC}'"),
                                 cat.collection_entries.where(f"archive = '{DEST}'"), SRC)
    return tr.remap_entries(entries_of(cat).where(f"archive = '{SRC}'"), merge_of(cat)[0], names, DEST)


@query("t10_stamped_history", f"""with {MERGE} select s.archive, s.run_id, cast(case when merged_note is null then 0 else 2 end + case when adopted_note is null then 0 else 1 end
  + case when p.run_id is null then 0 else 1 end as integer) as n_entries, coalesce('{DEST}|' || new_run_id, merged_note) as merged_to
from @sessions s left join plan p on s.archive = p.archive and s.run_id = p.run_id where s.archive = '{SRC}'""")
def stamped_history(cat):
    """Source sessions after a merge marked what became of them."""
    source = tr.history_of(cat).where(f"archive = '{SRC}'")
    marks = merge_of(cat)[0].select(*SESSION, F.concat(F.lit(f"{DEST}|"), "new_run_id").alias("note"))
    done = tr.stamp_history(source, marks, "merged", NOW)
    return done.select(*SESSION, F.size("history").alias("n_entries"), tr.merged_note(F.col("history")).alias("merged_to"))


@query("t16_merged_sessions", f"""with {MERGE} select '{DEST}' as archive, new_run_id as run_id, s.created, s.status, 'merge from {SRC}/' || s.run_id as note from plan p join @sessions s on s.archive = p.archive and s.run_id = p.run_id
union all select archive, run_id, created, status, coalesce(adopted_note, merged_note) from @sessions where archive = '{DEST}'""")
def merged_sessions(cat):
    """The destination's sessions once the intake archive has been merged."""
    every = tr.history_of(cat)
    arrived, _source = tr.apply_merge(merge_of(cat)[0], every.where(f"archive = '{SRC}'"), every.where(f"archive = '{DEST}'"), SRC, DEST, NOW)
    return arrived.select(*SESSION, "created", "status", F.get("history", F.size("history") - 1)["note"].alias("note"))


@query("t16_merge_again", f"""with {MERGE} select j.archive, j.run_id, coalesce('already merged as {DEST}|' || p.new_run_id, j.note) as note
from judged j left join plan p on j.archive = p.archive and j.run_id = p.run_id""")
def merge_again(cat):
    """A second merge moves nothing and says why, session by session."""
    every = tr.history_of(cat)
    arrived, source = tr.apply_merge(merge_of(cat)[0], every.where(f"archive = '{SRC}'"), every.where(f"archive = '{DEST}'"), SRC, DEST, NOW)
    plan, skipped = tr.plan_merge(source, source.limit(0).select(*SESSION), cat.files, arrived.select("run_id"), THIS_YEAR)
    return skipped.unionByName(plan.select(*SESSION, F.lit("would move").alias("note")))


def merged(cat, name):
    """One of the destination's tables after the merge."""
    tables = {name: getattr(cat, name)}
    repairs = tr.accept_unambiguous(repairs_of(cat)) if name == "edges" else None
    return tr.merge_tables(merge_of(cat)[0], tables, DEST, repairs)[name]


@query("t16_merged_files", f"""with {MERGE} select '{DEST}' as archive, p.new_run_id as run_id, t.name, t.size, t.sha256 from @files t join plan p on t.archive = p.archive and t.run_id = p.run_id
union all select archive, run_id, t.name, t.size, t.sha256 from @files t where archive = '{DEST}'""")
def merged_files(cat):
    return merged(cat, "files").select(*SESSION, "name", "size", "sha256")


@query("t16_merged_sidecars", f"""with {MERGE} select '{DEST}' as archive, p.new_run_id as run_id, t.filename, t.source, t.origin, t.sha256 from @sidecars t join plan p on t.archive = p.archive and t.run_id = p.run_id
union all select archive, run_id, t.filename, t.source, t.origin, t.sha256 from @sidecars t where archive = '{DEST}'""")
def merged_sidecars(cat):
    return merged(cat, "sidecars").select(*SESSION, "filename", "source", "origin", "sha256")


@query("t16_merged_annotations", f"""with {MERGE} select '{DEST}' as archive, p.new_run_id as run_id, t.filename, t.comment from @annotations t join plan p on t.archive = p.archive and t.run_id = p.run_id
union all select archive, run_id, t.filename, t.comment from @annotations t where archive = '{DEST}'""")
def merged_annotations(cat):
    return merged(cat, "annotations").select(*SESSION, "filename", "comment")


@query("t16_merged_renames", f"""with {MERGE} select '{DEST}' as archive, p.new_run_id as run_id, t.ord, t.old_name, t.new_name from @renames t join plan p on t.archive = p.archive and t.run_id = p.run_id
union all select archive, run_id, t.ord, t.old_name, t.new_name from @renames t where archive = '{DEST}'""")
def merged_renames(cat):
    return merged(cat, "renames").select(*SESSION, "ord", "old_name", "new_name")


@query("t16_merged_edges", f"""with {REPAIRS},
fixed as (select e.run_id, e.filename, e.ord, e.ref_archive, e.ref_asset, case when a.run_id is not null then a.fixed_session else e.ref_session end as s,
    case when a.run_id is not null then a.fixed_file else e.ref_file end as f
  from @edges e left join accepted a on e.ref_archive is null and e.run_id = a.run_id and e.filename is not distinct from a.filename and e.ref_session is not distinct from a.ref_session
    and e.ref_file is not distinct from a.ref_file where e.archive = '{SRC}')
select '{DEST}' as archive, h.new_run_id as run_id, x.filename, x.ord, case when ref_archive <> '{DEST}' then ref_archive end as ref_archive,
  case when coalesce(ref_archive, '{DEST}') = '{DEST}' then coalesce(t.new_run_id, s) else s end as ref_session, f as ref_file, ref_asset
from fixed x join plan h on x.run_id = h.run_id left join plan t on x.s = t.run_id
union all select archive, run_id, filename, ord, ref_archive, ref_session, ref_file, ref_asset from @edges where archive = '{DEST}'""")
def merged_edges(cat):
    return merged(cat, "edges").select(*SESSION, "filename", "ord", "ref_archive", "ref_session", "ref_file", "ref_asset")


@query("t16_merged_related_runs", f"""with {MERGE} select '{DEST}' as archive, h.new_run_id as run_id, case when ref_archive <> '{DEST}' then ref_archive end as ref_archive,
  case when coalesce(ref_archive, '{DEST}') = '{DEST}' then coalesce(t.new_run_id, ref_session) else ref_session end as ref_session, ref_file
from @related_runs r join plan h on r.archive = h.archive and r.run_id = h.run_id left join plan t on r.ref_session = t.run_id
union all select archive, run_id, ref_archive, ref_session, ref_file from @related_runs where archive = '{DEST}'""")
def merged_related_runs(cat):
    return merged(cat, "related_runs").select(*SESSION, "ref_archive", "ref_session", "ref_file")


@query("t16_sealed_refusals", f"""with {MERGE} select archive, run_id, new_run_id, id_year - 100 in (select year from @session_rows where archive = '{DEST}' and year <= 1997) as refused from plan""")
def sealed_refusals(cat):
    """Planned sessions whose year is sealed at the destination stay where they are."""
    seals = seals_of(cat).where(f"archive = '{DEST}'").select((F.col("year") + 100).alias("year"))
    free, refused = tr.unsealed(merge_of(cat)[0], seals)
    columns = [*SESSION, "new_run_id"]
    return free.select(*columns, F.lit(False).alias("refused")).unionByName(refused.select(*columns, F.lit(True).alias("refused")))


@query("t16_locked_archives", f"select archive, case when archive = '{SRC}' then '{NOW}' else merged_at end as merged_at, case when archive = '{SRC}' then '{DEST}' end as merged_to from @archives")
def locked_archives(cat):
    return tr.lock_archive(cat.archives, SRC, DEST, NOW).select("archive", "merged_at", "merged_to")


# -- the merge as a whole: sealed years refused, collections and code carried ---------------

FREE = f"""{MERGE}, free as (select * from plan where id_year - 100 not in (select year from @session_rows where archive = '{DEST}' and year <= 1997))"""


def free_of(cat):
    """The planned sessions that no sealed year refuses."""
    def plan():
        seals = seals_of(cat).where(f"archive = '{DEST}'").select((F.col("year") + 100).alias("year"))
        return tr.unsealed(merge_of(cat)[0], seals)[0]
    return cat.shared("merge-free", plan)


def whole_merge(cat, *names):
    """The applied merge, with the tables asked for beside sessions, archives and collections."""
    seals = seals_of(cat).where(f"archive = '{DEST}'").select((F.col("year") + 100).alias("year"))
    tables = {n: getattr(cat, n) for n in names} | {"sessions": tr.history_of(cat), "archives": cat.archives, "collection_entries": entries_of(cat)}
    return tr.merge_catalog(merge_of(cat)[0], seals, tables, SRC, DEST, NOW)


@query("t16_applied_files", f"""with {FREE} select '{DEST}' as archive, p.new_run_id as run_id, t.name, t.size, t.sha256 from @files t join free p on t.archive = p.archive and t.run_id = p.run_id
union all select archive, run_id, t.name, t.size, t.sha256 from @files t where archive = '{DEST}'""")
def applied_files(cat):
    """The destination's files after a merge that sealed years have held back in part."""
    return whole_merge(cat, "files")["files"].select(*SESSION, "name", "size", "sha256")


@query("t16_applied_source", f"""with {FREE} select s.archive, s.run_id, coalesce('{DEST}|' || p.new_run_id, merged_note) as merged_to from @sessions s
left join free p on s.archive = p.archive and s.run_id = p.run_id where s.archive = '{SRC}'""")
def applied_source(cat):
    """The source's sessions: those that a seal refused are not marked."""
    done = whole_merge(cat)["source_sessions"]
    return done.select(*SESSION, tr.merged_note(F.col("history")).alias("merged_to"))


@query("t16_applied_lock", f"""with {FREE}, n as (select (select count(*) from free) as moved, (select count(*) from plan) as planned)
select archive, case when archive = '{SRC}' and moved > 0 and moved = planned then '{NOW}' else merged_at end as merged_at from @archives, n""")
def applied_lock(cat):
    """The source is locked only if nothing of the plan was refused."""
    return whole_merge(cat)["archives"].select("archive", "merged_at")


@query("t16_merged_entries", f"""with {FREE}, {NAMES}, e as (select *, regexp_extract(ref, '([SI]-[0-9]+-[0-9]+)', 1) as ses from @collection_entries where archive = '{SRC}' and ref <> 'a|b|c')
select '{DEST}' as archive, n.new_name as collection, e.ord, case when ref like 'prov://%' or ref like '{SRC}|%' then ref when p.new_run_id is not null then replace(ref, ses, new_run_id)
  when ref like 'collections/%' then 'collections/' || coalesce(k.new_name, replace(ref, 'collections/', '')) else ref end as ref, note
from e join cnames n on e.collection = n.collection left join free p on e.ses = p.run_id left join cnames k on replace(ref, 'collections/', '') = k.collection
union all select archive, collection, ord, ref, note from @collection_entries where archive = '{DEST}'""")
def merged_entries(cat):
    """Every entry of the destination's collections after the merge."""
    return tr.merge_entries(entries_of(cat), free_of(cat), SRC, DEST)[0]


@query("t16_entries_left", f"select collection, ord, ref, note from @collection_entries where archive = '{SRC}' and ref = 'a|b|c'")
def entries_left(cat):
    """Malformed entries of the source's collections, which do not move."""
    return tr.merge_entries(entries_of(cat), free_of(cat), SRC, DEST)[1].select("collection", "ord", "ref", "note")


CODE = FREE + """, claimed as (select archive, run_id, code as manifest from @sidecars where code is not null and not trashed),
here as (select distinct manifest from @manifests where manifest < 'src2'),
arriving as (select distinct manifest from claimed c semi join free p on c.archive = p.archive and c.run_id = p.run_id where manifest not in (select manifest from here))"""


def code_after(cat):
    dest = cat.manifest_files.where("lang = 'fr'").select(F.col("blob").alias("digest"))
    held = cat.manifests.where("manifest < 'src2'")
    return tr.merge_code(free_of(cat), cat.sidecars, cat.manifests, cat.manifest_files, cat.code_blobs, held, dest)


@query("t16_merged_manifests", f"""with {CODE} select k.manifest, arrived, entry, bytes, entry is null as missing
from (select manifest, false as arrived from here union all select manifest, true from arriving) k left join @manifests m on k.manifest = m.manifest""")
def merged_manifests(cat):
    """Manifests after the merge, at a destination that held those before src2; one that no store holds is missing."""
    return code_after(cat)[0].select("manifest", "arrived", "entry", "bytes", "missing")


@query("t16_merged_blobs", f"""with {CODE}, need as (select distinct m.blob as digest from @manifest_files m semi join arriving a on m.manifest = a.manifest),
dst as (select distinct sha256(text) as digest from documents where lang = 'fr')
select n.digest, case when d.digest is not null then 'present' when s.digest is not null then 'copy' else 'missing' end as action, s.bytes
from need n left join dst d on n.digest = d.digest left join (select digest, max(bytes) as bytes from @code_blobs group by 1) s on n.digest = s.digest""")
def merged_blobs(cat):
    """Blobs that the arriving manifests need, at a destination that holds the French documents."""
    return code_after(cat)[1]


@query("t14_safe_to_delete", f"select archive, count(*) filter (where merged_note is null) as unmerged, count(*) filter (where merged_note is null) = 0 as safe from @sessions where archive = '{SRC}' group by 1")
def safe_to_delete(cat):
    return tr.safe_to_delete(tr.history_of(cat), cat.archives)


# -- adoption out of a fragment --------------------------------------------------------

ADOPT = f"""origins as (select regexp_extract(adopted_note, '([a-z]+://.*)$', 1) as origin, min(run_id) as adopted_as from @sessions where archive = '{DEST}' and adopted_note is not null group by 1),
src as (select s.archive, s.run_id, '{SCHEME}{OWNER}/MIDDLE EAST/' || run_id as origin from @sessions s where archive = 'MIDDLE EAST'),
fresh as (select s.* from src s anti join origins o on s.origin = o.origin), {new_ids_sql('fresh', 'taken')}"""


def adopt_of(cat):
    every = tr.history_of(cat)
    return tr.plan_adopt(every.where("archive = 'MIDDLE EAST'"), OWNER, SCHEME, cat.files,
                         every.where(f"archive = '{DEST}'").select(*SESSION, "history").unionByName(
                             cat.session_rows.where(f"archive = '{DEST}' and record_state <> 'ok'").select(
                                 *SESSION, F.array().cast(f"array<{tr.HISTORY_ENTRY}>").alias("history"))), THIS_YEAR)


@query("t09_adopt_plan", f"""with {ADOPT}, sized as (select archive, run_id, count(*) as n_files, cast(sum(size) as bigint) as bytes from @files group by 1, 2)
select t.archive, t.run_id, origin, id_year, new_run_id, coalesce(n_files, 0) as n_files, coalesce(bytes, 0) as bytes from taken t left join sized s on t.archive = s.archive and t.run_id = s.run_id""")
def adopt_plan(cat):
    return adopt_of(cat)[0]


@query("j16_already_adopted", f"with {ADOPT} select s.archive, s.run_id, 'already adopted as ' || adopted_as as note from src s join origins o on s.origin = o.origin")
def adopted_already(cat):
    return adopt_of(cat)[1]


# -- export -------------------------------------------------------------------------------

SELECTION = f"""whole as (select archive, run_id from @sessions where archive = '{DEST}' and tag_a = '1-URGENT' and year = 2001 and status = 'closed'
  union select e.archive, e.ref from @collection_entries e where archive = '{DEST}' and collection = 'Brand#4' and regexp_matches(ref, '^[SI]-[0-9]+-[0-9]+$')),
chosen as (select archive, run_id, filename from @annotations where archive = '{DEST}' and filename is not null and tag_b = 'R'
  union select e.archive, regexp_extract(ref, '([SI]-[0-9]+-[0-9]+)', 1), regexp_extract(ref, '[SI]-[0-9]+-[0-9]+/(.*)$', 1) from @collection_entries e
    where archive = '{DEST}' and collection = 'Brand#4' and regexp_matches(ref, '^({DEST}\\|)?[SI]-[0-9]+-[0-9]+/')),
picked as (select archive, run_id, {NO} as filename from whole union all select s.* from chosen s anti join whole w on s.archive = w.archive and s.run_id = w.run_id)"""


def selection_of(cat):
    sessions = cat.sessions.where(f"archive = '{DEST}' and tag_a = '1-URGENT' and year = 2001 and status = 'closed'")
    notes = cat.annotations.where(f"archive = '{DEST}' and filename is not null and tag_b = 'R'").select(
        "archive", F.col("run_id").alias("ref_session"), F.col("filename").alias("ref_file"))
    listed = entries_of(cat).where(
        f"archive = '{DEST}' and collection = 'Brand#4' and ref_user is null and coalesce(ref_archive, archive) = archive").select(
        "archive", "ref_session", "ref_file")
    return tr.expand_selection(sessions, notes.unionByName(listed))


@query("u05_selection", f"with {SELECTION} select * from picked")
def selection(cat):
    return selection_of(cat)


CLOSURE = SELECTION + """, start_nodes as (select archive, run_id, filename from picked where filename is not null
  union select f.archive, f.run_id, f.name from @files f semi join (select * from picked where filename is null) p on f.archive = p.archive and f.run_id = p.run_id),
inner_refs as (select *, coalesce(ref_session, run_id) as ts from @edges where ref_asset is null and (ref_archive is null or ref_archive = archive)),
nodes as (select * from start_nodes union select r.archive, r.ts, r.ref_file from nodes n join inner_refs r on n.archive = r.archive and n.run_id = r.run_id and n.filename = r.filename where r.ref_file is not null),
all_whole as (select archive, run_id from picked where filename is null union select r.archive, r.ts from inner_refs r semi join nodes n on r.archive = n.archive and r.run_id = n.run_id and r.filename = n.filename
  anti join (select * from picked where filename is not null) p on r.archive = p.archive and r.ts = p.run_id where r.ref_file is null),
closed as (select archive, run_id, cast(null as string) as filename from all_whole union all select n.* from nodes n anti join all_whole w on n.archive = w.archive and n.run_id = w.run_id),
foreign_refs as (select e.archive, e.run_id, e.filename, e.ref_user, e.ref_archive, e.ref_session, e.ref_file from @edges e semi join nodes n on e.archive = n.archive and e.run_id = n.run_id and e.filename = n.filename
  where ref_asset is null and ref_archive <> e.archive),
want as (select f.archive, f.run_id, f.name, f.size from @files f semi join all_whole w on f.archive = w.archive and f.run_id = w.run_id
  union all select c.archive, c.run_id, c.filename, f.size from closed c left join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where c.filename is not null),
sized as (select archive, run_id, count(*) as n_files, cast(sum(size) as bigint) as bytes from want where size is not null group by 1, 2),
whole_size as (select archive, run_id, count(*) as n from @files group by 1, 2),
plan as (select c.archive, c.run_id, coalesce(z.n_files, 0) as n_files, coalesce(z.bytes, 0) as bytes, coalesce(z.n_files, 0) < coalesce(w.n, 0) as partial, coalesce(w.n, 0) - coalesce(z.n_files, 0) as omitted
  from (select distinct archive, run_id from closed) c semi join @sessions s on c.archive = s.archive and c.run_id = s.run_id
  left join sized z on c.archive = z.archive and c.run_id = z.run_id left join whole_size w on c.archive = w.archive and c.run_id = w.run_id)"""


def closure_of(cat):
    def foreign():
        closed, elsewhere = tr.selection_closure(selection_of(cat), cat.files, cat.edges)
        cat.shared("closure", lambda: closed)
        return elsewhere

    elsewhere = cat.shared("closure-foreign", foreign)
    return cat.shared("closure", lambda: None), elsewhere


def exported_of(cat):
    """The closure with the sessions and files of its archives."""
    closed = closure_of(cat)[0]
    return closed, *cat.once("closure-tables", lambda: tr.in_archives_of(closed, cat.sessions, cat.files))


def wanted_of(closed, sessions, files):
    return tr.wanted_files(closed, files).join(sessions.select(*SESSION), SESSION, "left_semi")


@query("g05_selection_closure", f"with recursive {CLOSURE} select * from closed")
def selection_closure(cat):
    return closure_of(cat)[0]


@query("g05_foreign_refs", f"with recursive {CLOSURE} select * from foreign_refs")
def foreign_refs(cat):
    return closure_of(cat)[1]


@query("t01_export_plan", f"with recursive {CLOSURE} select *, false as foreign from plan")
def export_plan(cat):
    return tr.plan_export(*exported_of(cat))[0]


@query("t01_export_dangling", f"""with recursive {CLOSURE} select distinct c.archive, c.run_id, {NO} as name, 'session not found' as note from closed c anti join @sessions s on c.archive = s.archive and c.run_id = s.run_id
union all select w.archive, w.run_id, name, 'file is missing' from want w semi join @sessions s on w.archive = s.archive and w.run_id = s.run_id where size is null""")
def export_dangling(cat):
    return tr.plan_export(*exported_of(cat))[1]


FOREIGN = CLOSURE + """, held as (select s.archive, s.run_id from @sessions s semi join (select * from @archives where reachable) a on s.archive = a.archive),
asked as (select distinct ref_archive as archive, ref_session as run_id, ref_file as filename from foreign_refs),
fw as (select distinct a.archive, a.run_id from asked a semi join held h on a.archive = h.archive and a.run_id = h.run_id),
fz as (select a.archive, a.run_id, count(*) as n_files, cast(sum(f.size) as bigint) as bytes from asked a join @files f on a.archive = f.archive and a.run_id = f.run_id and a.filename = f.name group by 1, 2)"""


@query("t02_foreign_inclusion", f"""with recursive {FOREIGN} select w.archive, w.run_id, coalesce(z.n_files, 0) as n_files, coalesce(z.bytes, 0) as bytes, coalesce(z.n_files, 0) < coalesce(s.n, 0) as partial,
  coalesce(s.n, 0) - coalesce(z.n_files, 0) as omitted, true as foreign from fw w left join fz z on w.archive = z.archive and w.run_id = z.run_id left join whole_size s on w.archive = s.archive and w.run_id = s.run_id""")
def foreign_inclusion(cat):
    return tr.plan_foreign(closure_of(cat)[1], cat.archives, cat.sessions, cat.files)[0]


@query("t02_foreign_dangling", f"with recursive {FOREIGN} select f.* from foreign_refs f anti join held h on f.ref_archive = h.archive and f.ref_session = h.run_id")
def foreign_dangling(cat):
    return tr.plan_foreign(closure_of(cat)[1], cat.archives, cat.sessions, cat.files)[1]


@query("t03_needed_manifests", f"with recursive {CLOSURE} select distinct c.code as manifest from @sidecars c semi join want w on c.archive = w.archive and c.run_id = w.run_id and c.filename = w.name where code is not null and not trashed")
def needed_manifests(cat):
    closed, _, files = exported_of(cat)
    return tr.manifests_for(tr.wanted_files(closed, files), cat.sidecars)


@query("t04_export_collections", f"""with recursive {CLOSURE}, taken as (select w.* from want w semi join @sessions s on w.archive = s.archive and w.run_id = s.run_id where size is not null),
e as (select *, ref like 'prov://%' as away, ref like 'collections/%' as nested, regexp_extract(ref, '([SI]-[0-9]+-[0-9]+)', 1) as ses, regexp_extract(ref, '[SI]-[0-9]+-[0-9]+/(.*)$', 1) as fil
  from @collection_entries where ref <> 'a|b|c'),
j as (select e.archive, e.collection, e.ord, e.ref, nested or (not away and case when fil = '' then p.run_id is not null else t.name is not null end) as keep
  from e left join plan p on e.archive = p.archive and e.ses = p.run_id left join taken t on e.archive = t.archive and e.ses = t.run_id and e.fil = t.name)
select archive, collection, ord, ref, dropped from (select *, count(*) filter (where not keep) over (partition by archive, collection) as dropped from j) x where keep""")
def export_collections(cat):
    closed, sessions, files = exported_of(cat)
    plan, _ = tr.plan_export(closed, sessions, files)
    return tr.export_collections(entries_of(cat), plan, wanted_of(closed, sessions, files))


@query("t11_blob_transfer", """with need as (select distinct m.blob as digest from @manifest_files m semi join (select code from @sidecars where code is not null and not trashed) c on m.manifest = c.code),
src as (select digest, bytes from @code_blobs), dst as (select distinct sha256(text) as digest from documents where lang = 'fr')
select n.digest, case when d.digest is not null then 'present' when s.digest is not null then 'copy' else 'missing' end as action, s.bytes
from need n left join dst d on n.digest = d.digest left join src s on n.digest = s.digest""")
def blob_transfer(cat):
    """Code blobs to carry to a store that already holds the French documents."""
    used = cat.sidecars.where("code is not null and not trashed").select(F.col("code").alias("manifest"))
    dest = cat.manifest_files.where("lang = 'fr'").select(F.col("blob").alias("digest"))
    return tr.blob_transfer(used, cat.manifest_files, cat.code_blobs, dest)


# -- copies and receiving -------------------------------------------------------------------

# The copy a colleague already has: without orphaned rows, with some older bytes.
COPY = """copy_files as (select archive, run_id, filename as name, size, mtime, case when discount = 0.03 then 'older' else actual_sha256 end as sha256 from @artifacts
    where has_file and not trashed and tax <> 0.07 and year < 2001),
copy_sessions as (select distinct archive, run_id from @sessions where year < 2001)"""


def copy_of(cat):
    files = cat.artifacts.where("has_file and not trashed and tax <> 0.07 and year < 2001").select(
        "archive", "run_id", F.col("filename").alias("name"), "size", "mtime",
        F.when(F.col("discount") == 0.03, "older").otherwise(F.col("actual_sha256")).alias("sha256"))
    return cat.sessions.where("year < 2001").select(*SESSION), files


@query("j11_compared_copies", f"""with {COPY} select f.archive, f.run_id, count(*) filter (where c.sha256 = f.sha256) as same, count(*) filter (where c.sha256 is distinct from f.sha256) as differing
from @files f left join copy_files c on f.archive = c.archive and f.run_id = c.run_id and f.name = c.name group by 1, 2""")
def compared_copies(cat):
    return tr.compare_copies(cat.files, copy_of(cat)[1])


@query("t13_copy_verification", f"""with {COPY} select c.archive, c.run_id, count(*) as n_files from copy_files c left join @files f on f.archive = c.archive and f.run_id = c.run_id and f.name = c.name
group by 1, 2 having count(*) filter (where c.sha256 is distinct from f.sha256) = 0""")
def copy_verification(cat):
    """Sessions whose copy is proven complete and equal."""
    return tr.compare_copies(copy_of(cat)[1], cat.files).where("differing = 0").select(
        *SESSION, F.col("same").alias("n_files"))


RECEIVE = COPY + """, cmp as (select f.archive, f.run_id, count(*) filter (where c.sha256 = f.sha256) as same, count(*) filter (where c.sha256 is distinct from f.sha256) as differing
  from @files f left join copy_files c on f.archive = c.archive and f.run_id = c.run_id and f.name = c.name group by 1, 2),
actions as (select s.archive, s.run_id, coalesce(same, 0) as same, coalesce(differing, 0) as differing, case when k.run_id is null then 'add' when differing > 0 then 'conflict' when same > 0 then 'skip' else 'add' end as action
  from @sessions s left join copy_sessions k on s.archive = k.archive and s.run_id = k.run_id left join cmp m on s.archive = m.archive and s.run_id = m.run_id)"""


@query("u04_receive", f"with {RECEIVE} select * from actions")
def receive(cat):
    return tr.receive(cat.sessions, cat.files, *copy_of(cat))


@query("u04_received_files", f"""with {RECEIVE}, won as (select archive, run_id from actions where action = 'add')
select archive, run_id, name, sha256 from (select f.archive, f.run_id, f.name, f.sha256 from copy_files f anti join won w on f.archive = w.archive and f.run_id = w.run_id
  union all select f.archive, f.run_id, f.name, f.sha256 from @files f semi join won w on f.archive = w.archive and f.run_id = w.run_id) u""")
def received_files(cat):
    sessions, files = copy_of(cat)
    actions = tr.receive(cat.sessions, cat.files, sessions, files)
    columns = ["archive", "run_id", "name", "sha256"]
    return tr.union_tables(files.select(*columns), cat.files.select(*columns), actions)


@query("t15_receive_routing", """select s.archive, s.run_id, case when owner = '' then 'unknown' else owner end || '/' || s.archive as destination,
  case when kind <> 'fragment' then 'not a fragment but ' || kind end as refused from @sessions s join @archives a on s.archive = a.archive""")
def receive_routing(cat):
    return tr.receive_routing(cat.sessions.select(*SESSION), cat.archives).select(*SESSION, "destination", "refused")


@query("t01_export_requests", f"""with {ENTRIES}, picks as (select archive, collection, case when bad is null and ta = archive and ses <> '' then ses end as ses from e)
select p.archive, p.collection as request, count(distinct ses) as n_sessions, case when max(kind) = 'intake' then 'intake ids are provisional, merge first' when count(ses) = 0 then 'empty selection' end as refused
from picks p join @archives a on p.archive = a.archive group by p.archive, p.collection""")
def export_requests(cat):
    """Every collection asked for as an export: those that are refused, and the number of sessions of the others."""
    entries = parse_refs(cat.collection_entries, "ref")
    at_home = F.coalesce("ref_archive", "archive") == F.col("archive")
    requests = entries.withColumn("request", F.col("collection"))
    picked = requests.where(at_home & F.col("ref_error").isNull()).select("archive", "request", F.col("ref_session").alias("run_id"))
    return tr.export_requests(requests, picked, cat.archives)
