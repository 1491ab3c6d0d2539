"""The integrity audit, one query per kind of finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import refs
from tracelake.operators import audit as au
from tracelake.operators import refresh as rf
from tracelake.operators.items import SESSION
from tracelake.operators.lineage import current_names
from tracelake.plans.lineage import NAMES
from tracelake.plans.registry import query
from tracelake.plans.store import LIVE, SEALS, live_of, seals_of

NO = "cast(null as string)"
SHOWN = ["kind", "severity", "archive", "session", "file", "detail"]


def recorded(cat):
    """Sessions with a record, readable or not."""
    return cat.session_records.unionByName(cat.session_rejects).select(*SESSION).distinct()


def pairs_of(cat):
    """Files and sidecars brought together once, for all who ask about them."""
    return cat.shared("audit-pairs", lambda: au.paired(
        cat.files, cat.sidecars.where("readable and not trashed"), cat.sidecar_rejects.where("not trashed"), recorded(cat)))


def checked_edges(cat, to_assets: bool):
    """Edges to assets, or all others, of sidecars whose file is there; those of other sidecars are reported once, as gone."""
    def build():
        edges = cat.edges.where(F.col("ref_asset").isNotNull() if to_assets else F.col("ref_asset").isNull())
        return edges.join(pairs_of(cat).where("checked").select(*au.NODE), au.NODE, "left_semi")
    return cat.shared("audit-asset-edges" if to_assets else "audit-edges", build)


def entries_of(cat):
    parsed = refs.parse_refs(cat.collection_entries, "ref")
    names = cat.collection_entries.select("archive", "collection").distinct()
    return au.entry_status(parsed, cat.archives, cat.sessions, cat.files, names)


def _sessions(cat):
    return au.session_issues(cat.folders, cat.session_records, cat.session_rejects, cat.sessions)


def _artifacts(cat):
    return au.artifact_issues(pairs_of(cat))


def _references(cat):
    names = cat.shared("current-names", lambda: current_names(cat.renames))
    targets = au.reference_targets(pairs_of(cat), recorded(cat), cat.files, names)
    return au.reference_issues(checked_edges(cat, False), cat.related_runs, cat.archives, targets)


def _code(cat):
    return au.code_issues(pairs_of(cat).where("checked"), cat.manifests, cat.manifest_files, cat.code_blobs)


def _asset_refs(cat):
    return au.asset_ref_issues(checked_edges(cat, True), cat.asset_records, cat.asset_blobs)


def _assets(cat):
    return au.asset_issues(cat.asset_folders, cat.asset_records, cat.asset_rejects, cat.asset_files, cat.asset_snapshots,
                           cat.asset_blobs)


def _annotations(cat):
    return au.annotation_issues(cat.annotations, cat.files)


def _collections(cat):
    return au.collection_issues(entries_of(cat))


def _seals(cat):
    return au.seal_issues(rf.year_digests(live_of(cat)), seals_of(cat))


def _owners(cat):
    return au.owner_issues(cat.archives)


GROUPS = (_sessions, _artifacts, _references, _code, _asset_refs, _assets, _annotations, _collections, _seals, _owners)


def audit(cat):
    """Every finding of every kind."""
    out = None
    for group in GROUPS:
        found = group(cat)
        out = found if out is None else out.unionByName(found)
    return out


BASE = """existing as (select distinct archive, run_id from @folders where record_state <> 'missing'),
cars as (select c.* from @sidecars c semi join existing e on c.archive = e.archive and c.run_id = e.run_id where not trashed),
there as (select c.*, f.sha256 as actual from cars c join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where readable),
checked as (select e.* from @edges e semi join there t on e.archive = t.archive and e.run_id = t.run_id and e.filename = t.filename)"""
REFS = BASE + ", " + NAMES + """, refs as (select archive, run_id, filename, ref_archive, ref_session, ref_file, 'dangling_derived_from' as k from checked where ref_asset is null
  union all select archive, run_id, cast(null as string), ref_archive, ref_session, ref_file, 'dangling_related_run' from @related_runs),
local as (select *, coalesce(ref_session, run_id) as ts from refs where ref_archive is null),
mine as (select f.* from @files f semi join existing e on f.archive = e.archive and f.run_id = e.run_id),
judged as (select l.*, e.run_id is not null as has_session, f.name is not null as has_file, g.name as moved_to, coalesce(ref_file = filename and ts = l.run_id, false) as itself
  from local l left join existing e on l.archive = e.archive and l.ts = e.run_id left join mine f on l.archive = f.archive and l.ts = f.run_id and l.ref_file = f.name
  left join names n on l.archive = n.archive and l.ts = n.run_id and l.ref_file = n.old_name
  left join @files g on n.archive = g.archive and n.run_id = g.run_id and n.current_name = g.name)"""
GONE = """from judged where not itself and ((ref_file is null and not has_session) or (ref_file is not null and not has_file and moved_to is null))"""
KNOWN_ASSETS = BASE + """, arefs as (select e.*, a.asset_id is not null as known from checked e left join (select * from @assets where record_state = 'ok') a
  on e.archive = a.archive and e.ref_asset = a.asset_id where ref_asset is not null)"""
ENTRIES = """names as (select distinct archive, collection from @collection_entries),
e as (select *, case when ref like 'prov://%' then 'MIDDLE EAST' else archive end as ta,
  case when ref = 'a|b|c' then 'malformed: multiple_archive_separators' end as bad,
  regexp_extract(ref, '([SI]-[0-9]+-[0-9]+)', 1) as ses, case when ref like 'collections/%' then replace(ref, 'collections/', '') end as coll,
  regexp_extract(ref, '[SI]-[0-9]+-[0-9]+/(.*)$', 1) as fil from @collection_entries),
judged as (select e.archive, e.collection, e.ref, case when bad is not null then bad when ta <> e.archive then 'archive out of reach'
   when coll is not null then case when n.collection is null then 'no such collection' end
   when s.run_id is null then 'session not found' when fil <> '' and f.name is null then 'file is missing' end as problem
  from e left join names n on e.ta = n.archive and e.coll = n.collection left join @sessions s on e.ta = s.archive and e.ses = s.run_id
  left join @files f on e.ta = f.archive and e.ses = f.run_id and e.fil = f.name)"""
LISTS = "collection || ' lists ' || ref || ': ' || problem"


def _finding(kind: str, session: str, file: str, detail: str, source: str, prefix: str = "") -> str:
    severity = "info" if kind in au.INFO_KINDS else "error"
    head = f"with {prefix} " if prefix else ""
    return (f"{head}select '{kind}' as kind, '{severity}' as severity, archive, {session} as session, {file} as file, "
            f"{detail} as detail {source}")


CHECKED = (
    ("c01", "missing_session_yaml", _sessions, _finding("missing_session_yaml", "run_id", NO, "path", "from @folders where record_state = 'missing'")),
    ("c02", "duplicate_id", _sessions, _finding("duplicate_id", "run_id", NO, "cast(count(distinct path) as string) || ' folders'",
                                                "from @folders group by archive, run_id having count(distinct path) > 1")),
    ("c03", "unreadable_session_yaml", _sessions, _finding("unreadable_session_yaml", "run_id", NO, "path", "from @folders where record_state = 'unreadable'")),
    ("c04", "id_mismatch", _sessions, _finding("id_mismatch", "run_id", NO, "record_id", "from @sessions where record_id <> run_id")),
    ("c05", "invalid_status", _sessions, _finding("invalid_status", "run_id", NO, "status", "from @sessions where status not in ('open', 'closed', 'crashed')")),
    ("c06", "garbled_hold_until", _sessions, _finding("garbled_hold_until", "run_id", NO, "hold_until", "from @sessions where hold_until <> 'forever' and try_cast(hold_until as timestamptz) is null")),
    ("c07", "orphan", _artifacts, _finding("orphan", "f.run_id", "name", NO, """from (select g.* from @files g semi join existing e on g.archive = e.archive and g.run_id = e.run_id) f
      anti join (select * from @sidecars where not trashed) c on f.archive = c.archive and f.run_id = c.run_id and f.name = c.filename""", BASE)),
    ("c08", "unreadable_sidecar", _artifacts, _finding("unreadable_sidecar", "run_id", "filename", NO, "from cars where not readable", BASE)),
    ("c09", "missing_artifact", _artifacts, _finding("missing_artifact", "c.run_id", "filename", NO, "from cars c anti join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where readable", BASE)),
    ("c10", "checksum_mismatch", _artifacts, _finding("checksum_mismatch", "run_id", "filename", "substr(actual, 1, 12) || ' is not ' || substr(sha256, 1, 12)", "from there where sha256 <> actual", BASE)),
    ("c11", "dangling_derived_from", _references, _finding("dangling_derived_from", "run_id", "filename", "ts || coalesce('/' || ref_file, '')", GONE + " and k = 'dangling_derived_from'", REFS)),
    ("c12", "dangling_related_run", _references, _finding("dangling_related_run", "run_id", "filename", "ts || coalesce('/' || ref_file, '')", GONE + " and k = 'dangling_related_run'", REFS)),
    ("c13", "self_reference", _references, _finding("self_reference", "run_id", "filename", NO, "from judged where itself", REFS)),
    ("c14", "renamed_ref", _references, _finding("renamed_ref", "run_id", "filename", "ts || '/' || ref_file || ' -> ' || moved_to", "from judged where not itself and ref_file is not null and not has_file and moved_to is not null", REFS)),
    ("c15", "unresolved_cross_archive_ref", _references, _finding("unresolved_cross_archive_ref", "run_id", "filename", "ref_archive", "from refs where ref_archive is not null and ref_archive not in (select archive from @archives where reachable)", REFS)),
    ("c16", "dangling_code_ref", _code, _finding("dangling_code_ref", "run_id", "filename", "code", "from there where code is not null and code not in (select manifest from @manifests)", BASE)),
    ("c17", "missing_code_blob", _code, _finding("missing_code_blob", "run_id", "filename", "shown", """from there join gone on code = manifest""", BASE + """, absent as (select *, row_number() over (partition by manifest order by path) as r,
      count(*) over (partition by manifest) as n from @manifest_files where blob not in (select digest from @code_blobs)),
      gone as (select manifest, string_agg(path, ', ' order by path) || case when max(n) > 3 then ' and ' || cast(max(n) - 3 as string) || ' more' else '' end as shown from absent where r <= 3 group by 1)""")),
    ("c18", "dangling_asset_ref", _asset_refs, _finding("dangling_asset_ref", "run_id", "filename", "ref_asset", "from arefs where not known", KNOWN_ASSETS)),
    ("c19", "missing_asset_blob", _asset_refs, _finding("missing_asset_blob", "run_id", "filename", "ref_asset || ' @ ' || substr(ref_sha256, 1, 12)", "from arefs where known and ref_fidelity = 'pinned' and ref_sha256 is not null and ref_sha256 not in (select digest from @asset_blobs)", KNOWN_ASSETS)),
    ("c20", "unpinned_asset_ref", _asset_refs, _finding("unpinned_asset_ref", "run_id", "filename", "ref_asset", "from arefs where known and ref_sha256 is null", KNOWN_ASSETS)),
    ("c22", "orphan_asset_dir", _assets, _finding("orphan_asset_dir", NO, "asset_id", NO, "from @assets where record_state = 'missing'")),
    ("c23", "unreadable_asset", _assets, _finding("unreadable_asset", NO, "asset_id", NO, "from @assets where record_state = 'unreadable'")),
    ("c24", "missing_asset_file", _assets, _finding("missing_asset_file", NO, "asset_id", "name", "from @assets where record_state = 'ok' and live_name is null")),
    ("c25", "missing_asset_blob", _assets, _finding("missing_asset_blob", NO, "asset_id", "substr(sha256, 1, 12) || ' ' || cast(ord as string)", """from @asset_snapshots where not pending_gc
      and sha256 not in (select digest from @asset_blobs) and (archive, asset_id) in (select (archive, asset_id) from @assets where record_state = 'ok')""")),
    ("c26", "unscanned_asset_rename", _assets, _finding("unscanned_asset_rename", NO, "asset_id", "name || ' -> ' || live_name", "from @assets where record_state = 'ok' and live_name <> name")),
    ("c27", "annotation_without_file", _annotations, _finding("annotation_without_file", "a.run_id", "filename", NO, "from @annotations a anti join @files f on a.archive = f.archive and a.run_id = f.run_id and a.filename = f.name where filename is not null")),
    ("c28", "dangling_collection_entry", _collections, _finding("dangling_collection_entry", NO, NO, LISTS, "from judged where problem is not null and problem not like 'malformed%' and problem <> 'archive out of reach'", ENTRIES)),
    ("c28", "unresolvable_collection_entry", _collections, _finding("unresolvable_collection_entry", NO, NO, LISTS, "from judged where problem like 'malformed%' or problem = 'archive out of reach'", ENTRIES)),
    ("c29", "year_seal_mismatch", _seals, _finding("year_seal_mismatch", NO, NO, """case when coalesce(l.sessions, 0) <> s.sessions then cast(s.year as string) || ': ' || cast(s.sessions as string) || ' -> ' || cast(coalesce(l.sessions, 0) as string) || ' sessions'
      else cast(s.year as string) || ': same number of sessions, other content' end""", "from seals s left join live_years l on s.archive = l.archive and s.year = l.year where s.digest is distinct from l.digest", f"{LIVE}, {SEALS}").replace("archive, cast(null", "s.archive, cast(null", 1)),
    ("c30", "no_owner", _owners, _finding("no_owner", NO, NO, "owner", "from @archives where owner = ''")),
    ("c30", "unqualified_owner", _owners, _finding("unqualified_owner", NO, NO, "owner", "from @archives where owner <> '' and owner not like '%@%'")),
)


def _register(code: str, kind: str, group, sql: str) -> None:
    @query(f"{code}_{kind}", sql)
    def finding(cat):
        return group(cat).where(F.col("kind") == kind).select(*SHOWN)


for _row in CHECKED:
    _register(*_row)


@query("c21_asset_edges_apart", f"""with {KNOWN_ASSETS}, {REFS[len(BASE) + 2:]}, holders as (select distinct archive, run_id, filename from arefs),
found as (select archive, run_id, filename, case when itself then 'self_reference' when ref_file is null and has_session then null when has_file then null
    when ref_file is not null and moved_to is not null then 'renamed_ref' else k end as kind from judged
  union all select archive, run_id, filename, 'unresolved_cross_archive_ref' from refs where ref_archive is not null and ref_archive not in (select archive from @archives where reachable)
  union all select archive, run_id, filename, case when not known then 'dangling_asset_ref' when ref_sha256 is null then 'unpinned_asset_ref'
    when ref_fidelity = 'pinned' and ref_sha256 not in (select digest from @asset_blobs) then 'missing_asset_blob' end from arefs)
select kind, count(*) as n from found f semi join holders h on f.archive = h.archive and f.run_id = h.run_id and f.filename = h.filename where kind is not null group by kind""")
def asset_edges_apart(cat):
    """What is found in files that refer to assets: asset edges by their own rules only, the other edges by theirs."""
    holders = checked_edges(cat, True).select("archive", F.col("run_id").alias("session"), F.col("filename").alias("file"))
    found = _references(cat).unionByName(_asset_refs(cat))
    return found.join(holders, ["archive", "session", "file"], "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


def _all_kinds() -> str:
    return " union all ".join(f"select * from ({sql})" for _code, _kind, _group, sql in CHECKED)


@query("a08_issue_summary", f"select severity, count(*) as n from ({_all_kinds()}) t group by 1")
def issue_summary(cat):
    """Errors and notes of the whole audit."""
    return au.summary(audit(cat))
