"""Reference joins and graph walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import refs
from tracelake.operators import lineage as li
from tracelake.plans.items import CORPUS, items_of, sessions_of
from tracelake.plans.registry import query

NODE = li.NODE
NO = "cast(null as string)"

# Turns of a conversation as files derived from the turn before; the opening
# turn of an assistant-less conversation comes from an archive nobody has.
TURNS = f"""select 'EUROPE' as archive, 'C-' || cast(conv_id as string) as run_id, 'turn-' || cast(turn as string) as filename,
  0 as ord, {NO} as ref_user, case when role = 'system' then 'ATLANTIS' end as ref_archive,
  case when role = 'system' then 'S-00-0001' end as ref_session,
  case when role = 'system' then 'prompt.txt' else 'turn-' || cast(turn - 1 as string) end as ref_file,
  {NO} as ref_collection, {NO} as ref_asset, {NO} as ref_sha256, {NO} as ref_fidelity
from {{conversations}} where turn > 0 or role = 'system'"""
TURNS_SQL = "turns as (" + TURNS.replace("{conversations}", "conversations") + ")"

LINKS = """links as (select distinct archive, run_id, filename, coalesce(ref_archive, archive) as pa, coalesce(ref_session, run_id) as pr, ref_file as pf
  from @edges where ref_asset is null and ref_file is not null)"""


def turn_edges(cat):
    return cat.spark.sql(TURNS, conversations=cat.conversations)


def turn_nodes(cat):
    return cat.conversations.select(
        F.lit("EUROPE").alias("archive"), F.concat(F.lit("C-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("filename"))


def figures(cat):
    """Every figure in the catalog: what one asks the origin of."""
    return cat.sidecars.where("readable and not trashed and filename like '%.svg'").select(*NODE)


@query("j02_artifact_paths", """select a.archive, a.run_id, a.filename, s.rel_path || '/' || a.filename as path
from (select * from @sidecars where not trashed) a left join @sessions s on a.archive = s.archive and a.run_id = s.run_id""")
def artifact_paths(cat):
    return li.artifact_paths(cat.sidecars.where("not trashed").select(*NODE), cat.sessions)


@query("j03_session_detail", """
with r as (select archive, run_id, 2 as section, '' as item, 0 as ord, coalesce(ref_archive, '(local)') || '|' || ref_session || '/(whole session)' as text from @related_runs
 union all select archive, run_id, 3, filename, 0, case when source = 'external' then 'external: ' || coalesce(origin, '(no origin recorded)')
  else coalesce(repo, '-') || '@' || coalesce(substr(commit, 1, 8), '-') || case when dirty then ' (dirty)' else '' end end from @sidecars where not trashed
 union all select archive, run_id, 4, filename, ord, coalesce(ref_archive, '(local)') || '|' || coalesce(ref_session, '(same session)') || '/' || coalesce(ref_file, '(whole session)') from @edges)
select archive, run_id, 1 as section, '' as item, 0 as ord, created || ' ' || status || ' ' || description as text from @sessions
union all select r.* from r semi join @sessions s on r.archive = s.archive and r.run_id = s.run_id""")
def session_detail(cat):
    return li.session_detail(cat.sessions, cat.related_runs, cat.sidecars, cat.edges)


# Where a logged name ends up: the log holds draft -> temp -> line chains.
NAMES = """names as (select a.archive, a.run_id, a.old_name, coalesce(b.new_name, a.new_name) as current_name
  from @renames a left join @renames b on a.archive = b.archive and a.run_id = b.run_id and a.new_name = b.old_name)"""

STATUS = NAMES + """, targets as (select e.*, coalesce(ref_archive, e.archive) as ta, coalesce(ref_session, e.run_id) as ts, ref_file as tf from @edges e where ref_asset is null),
ref_status as (select t.archive, t.run_id, t.filename, t.ord, ta as to_archive, ts as to_session,
    case when t.ta <> t.archive and a.archive is null then 'archive not registered' when t.ta <> t.archive and not a.reachable then 'archive not mounted'
      when s.run_id is null then 'session not found' when tf is null or f.name is not null then null
      when n.current_name is not null then 'renamed from ' || tf else 'file is missing' end as note,
    tf, n.current_name
  from targets t left join @archives a on t.ta = a.archive left join @sessions s on t.ta = s.archive and t.ts = s.run_id
  left join @files f on t.ta = f.archive and t.ts = f.run_id and t.tf = f.name
  left join (select n.* from names n semi join @files g on n.archive = g.archive and n.run_id = g.run_id and n.current_name = g.name) n
    on t.ta = n.archive and t.ts = n.run_id and t.tf = n.old_name),
resolved as (select archive, run_id, filename, ord, to_archive, to_session, case when note like 'renamed%' then current_name else tf end as to_file, note,
    coalesce(note not like 'archive %', true) as resolved, note is null or note like 'renamed%' as exists from ref_status)"""


def _statuses(cat):
    plain = li.resolve_edges(cat.edges.where("ref_asset is null")).select(
        *NODE, "ord", "to_archive", "to_session", "to_file")
    return li.ref_status(plain, cat.archives, cat.sessions, cat.files, cat.shared("current-names", lambda: li.current_names(cat.renames)))


@query("j05_ref_status", f"with {STATUS} select * from resolved")
def ref_status(cat):
    return _statuses(cat)


@query("j06_direct_dependents", """select archive, coalesce(ref_session, run_id) as run_id, ref_file as filename, run_id as child_run_id, filename as child_filename
from @edges where ref_archive is null and ref_asset is null and ref_file is not null""")
def direct_dependents(cat):
    return li.direct_dependents(cat.edges)


@query("j07_inbound_references", f"""select archive, ref_session as run_id, run_id as from_run_id, filename as from_filename, 'derived_from' as via from @edges
  where ref_archive is null and ref_asset is null and ref_session <> run_id
union all select archive, ref_session, run_id, {NO}, 'related_run' from @related_runs where ref_archive is null and ref_session <> run_id""")
def inbound_references(cat):
    return li.inbound_references(cat.edges, cat.related_runs)


@query("j08_asset_usage", "select archive, ref_asset as asset_id, run_id, filename, ref_sha256 as sha256, ref_fidelity as fidelity from @edges where ref_asset is not null")
def asset_usage(cat):
    return li.asset_usage(cat.edges)


RENAMING = "renaming as (select archive, run_id, filename as old_name, 'renamed-' || filename as new_name from @sidecars where readable and not trashed and source = 'external')"


@query("j09_rename_referrers", f"""with {RENAMING}, {LINKS.replace('select distinct', 'select ord,')}
select l.archive, l.run_id, l.filename, l.ord, pa as to_archive, pr as to_session, old_name, new_name
from links l join renaming r on l.pa = r.archive and l.pr = r.run_id and l.pf = r.old_name""")
def rename_referrers(cat):
    chosen = cat.sidecars.where("readable and not trashed and source = 'external'").select(
        "archive", "run_id", F.col("filename").alias("old_name"), F.concat(F.lit("renamed-"), "filename").alias("new_name"))
    return li.rename_referrers(cat.edges, chosen, "all")


@query("j10_containing_collections", """select distinct f.archive, f.run_id, f.name, e.collection from @collection_entries e join @files f
  on e.archive = f.archive and (e.ref = f.run_id || '/' || f.name)""")
def containing_collections(cat):
    """Which collections list each file, by the canonical spelling of the entry."""
    entries = refs.canonical_refs(cat.collection_entries, "ref").select("archive", "collection", "canonical")
    named = cat.files.select("archive", "run_id", "name", F.concat_ws("/", "run_id", "name").alias("canonical"))
    return named.join(entries, ["archive", "canonical"]).select("archive", "run_id", "name", "collection").distinct()


@query("g01_upstream_turns", f"""with recursive {TURNS_SQL},
links as (select archive, run_id, filename, coalesce(ref_archive, archive) as pa, coalesce(ref_session, run_id) as pr, ref_file as pf from turns),
up as (select run_id as seed, filename as seed_file, pa, pr, pf, 1 as depth from links
  union select u.seed, u.seed_file, l.pa, l.pr, l.pf, u.depth + 1 from up u join links l on u.pa = l.archive and u.pr = l.run_id and u.pf = l.filename)
select 'EUROPE' as seed_archive, seed as seed_run_id, seed_file as seed_filename, pa as archive, pr as run_id, pf as filename,
  min(depth) as depth, min(depth) = 50 as truncated,
  pa = 'ATLANTIS' as unresolved from up group by all""")
def upstream_turns(cat):
    """Every turn's full history, all turns at once."""
    return li.upstream(turn_nodes(cat), turn_edges(cat), cat.archives)


@query("g01_upstream_figures", f"""with recursive {LINKS}, open_links as (select l.* from links l semi join (select * from @archives where reachable) a on l.archive = a.archive),
up as (select s.archive as sa, s.run_id as sr, s.filename as sf, l.pa, l.pr, l.pf from @sidecars s join open_links l
    on s.archive = l.archive and s.run_id = l.run_id and s.filename = l.filename where readable and not trashed and s.filename like '%.svg'
  union select u.sa, u.sr, u.sf, l.pa, l.pr, l.pf from up u join open_links l on u.pa = l.archive and u.pr = l.run_id and u.pf = l.filename)
select sa as seed_archive, sr as seed_run_id, sf as seed_filename, pa as archive, pr as run_id, pf as filename,
  false as truncated, not coalesce(reachable, false) as unresolved from up left join @archives a on up.pa = a.archive where (sa, sr, sf) <> (pa, pr, pf)""")
def upstream_figures(cat):
    """Everything every figure was derived from, across archives."""
    return li.upstream(figures(cat), cat.edges, cat.archives).drop("depth")


@query("g02_downstream_turns", f"""with recursive {TURNS_SQL}, links as (select run_id, filename, ref_file as pf from turns where ref_archive is null),
down as (select run_id as seed, pf as seed_file, filename, 1 as depth from links
  union select d.seed, d.seed_file, l.filename, d.depth + 1 from down d join links l on l.run_id = d.seed and l.pf = d.filename)
select 'EUROPE' as seed_archive, seed as seed_run_id, seed_file as seed_filename, 'EUROPE' as archive, seed as run_id, filename, min(depth) as depth,
  min(depth) = 50 as truncated from down group by all""")
def downstream_turns(cat):
    return li.downstream(turn_nodes(cat), turn_edges(cat))


@query("g02_downstream_files", f"""with recursive {LINKS}, scanned as (select * from links where archive in ('EUROPE', 'ASIA') and pa in ('EUROPE', 'ASIA')),
down as (select s.archive as sa, s.run_id as sr, s.filename as sf, l.archive, l.run_id, l.filename from @sidecars s join scanned l
    on s.archive = l.pa and s.run_id = l.pr and s.filename = l.pf where readable and not trashed and s.archive = 'EUROPE' and s.filename = 'line-1.csv'
  union select d.sa, d.sr, d.sf, l.archive, l.run_id, l.filename from down d join scanned l on d.archive = l.pa and d.run_id = l.pr and d.filename = l.pf)
select sa as seed_archive, sr as seed_run_id, sf as seed_filename, archive, run_id, filename, false as truncated from down where (sa, sr, sf) <> (archive, run_id, filename)""")
def downstream_files(cat):
    """What came of every first file of one archive, also in another."""
    seeds = cat.sidecars.where("readable and not trashed and archive = 'EUROPE' and filename = 'line-1.csv'").select(*NODE)
    return li.downstream(seeds, cat.edges, ["EUROPE", "ASIA"]).drop("depth")


@query("g03_provenance_tree", f"""with {LINKS}, ok as (select archive from @archives where reachable),
roots as (select archive, run_id, filename from @sidecars where readable and not trashed and filename like '%.svg'),
l1 as (select r.archive as ra, r.run_id as rr, r.filename as rf, r.archive as fa, r.run_id as fr, r.filename as ff, pa, pr, pf,
    (pa, pr, pf) = (r.archive, r.run_id, r.filename) as seen, pa in (select archive from ok) as resolved
  from roots r join links l on r.archive = l.archive and r.run_id = l.run_id and r.filename = l.filename),
o1 as (select distinct ra, rr, rf, pa, pr, pf from l1 where not seen and resolved),
l2 as (select o.ra, o.rr, o.rf, o.pa as fa, o.pr as fr, o.pf as ff, l.pa, l.pr, l.pf,
    (l.pa, l.pr, l.pf) = (o.ra, o.rr, o.rf) or old.pf is not null
      or row_number() over (partition by o.ra, o.rr, o.rf, l.pa, l.pr, l.pf order by o.pa, o.pr, o.pf) > 1 as seen,
    l.pa in (select archive from ok) as resolved
  from o1 o join links l on o.pa = l.archive and o.pr = l.run_id and o.pf = l.filename
  left join o1 old on old.ra = o.ra and old.rr = o.rr and old.rf = o.rf and old.pa = l.pa and old.pr = l.pr and old.pf = l.pf),
every as (select *, 1 as depth from l1 union all select *, 2 from l2)
select ra as root_archive, rr as root_run_id, rf as root_filename, fa as from_archive, fr as from_run_id, ff as from_filename,
  pa as archive, pr as run_id, pf as filename, depth, seen, resolved,
  case when not resolved then true when seen or depth < 2 then false else exists (select 1 from links l where l.archive = every.pa and l.run_id = every.pr and l.filename = every.pf) end as truncated,
  resolved and exists (select 1 from @files f where f.archive = every.pa and f.run_id = every.pr and f.name = every.pf) as exists
from every""")
def provenance_tree(cat):
    return li.provenance_tree(figures(cat), cat.edges, cat.files, cat.archives, "up", depth=2)


@query("g04_one_hop_lineage", f"""with {STATUS}
select archive, run_id, filename, 'up' as direction, to_archive, to_session, to_file, exists, note from resolved
union all select d.archive, coalesce(ref_session, d.run_id), ref_file, 'down', d.archive, d.run_id, d.filename, f.name is not null, {NO}
from (select * from @edges where ref_archive is null and ref_asset is null and ref_file is not null) d
left join @files f on d.archive = f.archive and d.run_id = f.run_id and d.filename = f.name""")
def one_hop_lineage(cat):
    up = _statuses(cat).select(*NODE, F.lit("up").alias("direction"), "to_archive", "to_session", "to_file", "exists", "note")
    there = cat.files.select("archive", F.col("run_id").alias("child_run_id"), F.col("name").alias("child_filename"),
                             F.lit(True).alias("there"))
    down = li.direct_dependents(cat.edges).join(there, ["archive", "child_run_id", "child_filename"], "left").select(
        *NODE, F.lit("down").alias("direction"), F.col("archive").alias("to_archive"),
        F.col("child_run_id").alias("to_session"), F.col("child_filename").alias("to_file"),
        F.coalesce("there", F.lit(False)).alias("exists"), F.lit(None).cast("string").alias("note"))
    return up.unionByName(down)


# -- collections ---------------------------------------------------------------

NESTED = """nested as (select distinct archive, collection as parent, replace(ref, 'collections/', '') as child from @collection_entries where ref like 'collections/%'),
names as (select distinct archive, collection from @collection_entries)"""


def nested_of(cat):
    parsed = refs.parse_refs(cat.collection_entries, "ref")
    return li.collection_links(parsed), cat.collection_entries.select("archive", "collection").distinct()


@query("g06_collection_tree", f"""with recursive {NESTED}, live as (select n.* from nested n semi join names k on n.archive = k.archive and n.child = k.collection),
tree as (select archive, collection as root, cast(null as string) as parent, collection as name, [collection] as path, 0 as depth, false as cycle from names
  union all select t.archive, t.root, t.name, l.child, list_append(t.path, l.child), t.depth + 1, list_contains(t.path, l.child)
  from tree t join live l on t.archive = l.archive and t.name = l.parent where not t.cycle and t.depth < 8)
select archive, root, parent, name, array_to_string(path, '>') as path, depth, cycle, not cycle and depth = 8 as truncated from tree where depth > 0""")
def collection_tree(cat):
    links, names = nested_of(cat)
    return li.collection_tree(links, names, names).withColumn("path", F.array_join("path", ">"))


@query("g07_collection_reach", f"""with recursive {NESTED}, reach as (select archive, parent as start, child as target from nested
  union select r.archive, r.start, n.child from reach r join nested n on r.archive = n.archive and r.target = n.parent) select archive, start, target from reach""")
def collection_reach(cat):
    return li.collections_reached(nested_of(cat)[0])


@query("g08_hierarchy_roots", f"""with recursive {NESTED}, top as (select k.* from names k anti join nested n on k.archive = n.archive and k.collection = n.child),
reach as (select archive, collection from top union select r.archive, n.child from reach r join nested n on r.archive = n.archive and r.collection = n.parent)
select archive, collection, false as in_cycle from top union all select k.archive, k.collection, true from names k anti join reach r on k.archive = r.archive and k.collection = r.collection""")
def hierarchy_roots(cat):
    return li.hierarchy_roots(*nested_of(cat))


@query("g09_rename_log", f"with {NAMES} select archive, run_id, old_name, current_name from names")
def rename_log(cat):
    return li.current_names(cat.renames)


@query("flagship_search_with_lineage", f"""with recursive {CORPUS}, {LINKS},
open_links as (select l.* from links l semi join (select * from @archives where reachable) a on l.archive = a.archive),
hits as (select archive, run_id, name as filename, verified_status as status, timestamp from corpus where lower(name) like '%.svg'),
up as (select h.archive as sa, h.run_id as sr, h.filename as sf, l.pa, l.pr, l.pf, 1 as depth from hits h join open_links l
    on h.archive = l.archive and h.run_id = l.run_id and h.filename = l.filename
  union select u.sa, u.sr, u.sf, l.pa, l.pr, l.pf, u.depth + 1 from up u join open_links l
    on u.pa = l.archive and u.pr = l.run_id and u.pf = l.filename where u.depth < 50),
nearest as (select sa, sr, sf, pa, pr, pf, min(depth) as depth from up where (sa, sr, sf) <> (pa, pr, pf) group by all),
origins as (select sa, sr, sf, count(*) as n, max(depth) as deepest, count(*) filter (not coalesce(reachable, false)) as lost
  from nearest left join @archives a on pa = a.archive group by all),
counted as (select archive, run_id, count(*) filter (verified_status <> 'paired') as n_problems from corpus group by all)
select h.archive, h.run_id, h.filename, h.status, h.timestamp, n_problems, coalesce(n, 0) as n_origins,
  coalesce(deepest, 0) as deepest, coalesce(lost, 0) as n_unresolved
from hits h join counted c on h.archive = c.archive and h.run_id = c.run_id
  left join origins o on h.archive = sa and h.run_id = sr and h.filename = sf""")
def flagship(cat):
    """Search hits, their session's problem count and how deep their origins go."""
    from tracelake.operators.items import session_counts
    from tracelake.operators.search import search_items
    from tracelake.plans.items import annotations_of

    items = items_of(cat, True)
    hits = search_items(items, sessions_of(cat), annotations_of(cat), "file:'*.svg'", limit=None).select(
        "archive", "run_id", F.col("name").alias("filename"), "status", "timestamp")
    origins = li.upstream(hits.select(*NODE), cat.edges, cat.archives).groupBy(
        *[F.col("seed_" + c).alias(c) for c in NODE]).agg(
        F.count("*").alias("n_origins"), F.max("depth").alias("deepest"),
        F.count_if("unresolved").alias("n_unresolved"))
    zero = F.lit(0)
    return (
        hits.join(session_counts(items).select("archive", "run_id", "n_problems"), ["archive", "run_id"])
        .join(origins, NODE, "left")
        .select(*NODE, "status", "timestamp", "n_problems", F.coalesce("n_origins", zero).alias("n_origins"),
                F.coalesce("deepest", zero).alias("deepest"), F.coalesce("n_unresolved", zero).alias("n_unresolved"))
        .orderBy(*NODE)
    )
