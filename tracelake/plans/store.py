"""Stores, versions, retention and refresh (A6, A10-A12, A15, J17-J19, N, R, U1-U3, W4-W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.times import as_iso
from tracelake.operators import refresh as rf
from tracelake.operators import store as st
from tracelake.plans.items import RESOLVED, now
from tracelake.plans.registry import THIS_YEAR, query

ASSET_NOW = "2024-01-20T00:00:00+00:00"


def snapshots_of(cat):
    return cat.asset_snapshots.withColumn("at", as_iso(F.col("ts").cast("timestamp")))


def capped_of(cat):
    return st.with_archive_settings(cat.assets, cat.archives)


@query("a06_manifest_statistics", """
with u as (select blob, count(distinct manifest) as users from @manifest_files group by 1)
select m.manifest, count(*) as n_files, count(distinct m.blob) as n_blobs, count(distinct case when c.digest is not null then m.blob end) as blobs_present,
  count(*) filter (where users > 1) as shared, count(*) filter (where users = 1) as unique
from @manifest_files m join u on m.blob = u.blob left join (select distinct digest from @code_blobs) c on m.blob = c.digest group by 1""")
def manifest_statistics(cat):
    return st.manifest_statistics(cat.manifest_files, cat.code_blobs)


@query("a06_files_per_repo", "select manifest, split_part(path, '/', 1) as repo, count(*) as n from @manifest_files group by 1, 2")
def files_per_repo(cat):
    return st.files_per_repo(cat.manifest_files)


# -- signatures ------------------------------------------------------------------

def _sig_sql(source: str, name: str) -> str:
    def part(expr: str, i: int) -> str:
        return f"cast(sum(cast(cast('0x' || substr(sha256({expr}), {1 + 15 * i}, 15) as bigint) as hugeint)) as string)"
    line = "name || ':' || cast(size as string) || ':' || mtime"
    ses = "run_id || ':' || sig"
    return f"""{name} as (select archive, year, run_id, sha256(cast(count(*) as string) || ':' || {part(line, 0)} || ':' || {part(line, 1)}) as sig
    from @{source} group by 1, 2, 3),
  {name}_years as (select archive, year, count(*) as sessions, sha256(cast(count(*) as string) || ':' || {part(ses, 0)} || ':' || {part(ses, 1)}) as digest
    from {name} group by 1, 2)"""


LIVE, INDEXED = _sig_sql("live_stats", "live"), _sig_sql("indexed_stats", "indexed")
SEALS = INDEXED + ", seals as (select * from indexed_years where year <= 1997), known_seals as (select * from seals where archive <> 'AMERICA')"


def live_of(cat):
    return rf.session_signatures(cat.live_stats)


def indexed_of(cat):
    return rf.session_signatures(cat.indexed_stats)


def seals_of(cat):
    return rf.year_digests(indexed_of(cat)).where("year <= 1997")


@query("a10_session_signatures", f"with {LIVE} select * from live")
def session_signatures(cat):
    return live_of(cat)


@query("a10_asset_signatures", """select archive, asset_id, sha256(coalesce(name, '~') || '|' || coalesce(created, '~') || '|' || coalesce(scanned_at, '~') || '|' ||
  coalesce(policy, '~') || '|' || coalesce(cast(size as string), '~') || '|' || coalesce(sha256, '~')) as sig from @assets""")
def asset_signatures(cat):
    return rf.asset_signatures(cat.assets)


@query("a11_year_digests", f"with {LIVE} select * from live_years")
def year_digests(cat):
    return rf.year_digests(live_of(cat))


DIFF = f"""{LIVE}, {INDEXED}, changes as (select coalesce(l.archive, i.archive) as archive, coalesce(l.year, i.year) as year, coalesce(l.run_id, i.run_id) as run_id,
  case when i.run_id is null then 'added' when l.run_id is null then 'removed' when i.sig <> l.sig then 'updated' else 'unchanged' end as change
  from live l full outer join indexed i on l.archive = i.archive and l.year = i.year and l.run_id = i.run_id)"""


@query("u01_catalog_diff", f"with {DIFF} select * from changes")
def catalog_diff(cat):
    return rf.diff(indexed_of(cat), live_of(cat), ["archive", "year", "run_id"]).drop("indexed_sig", "live_sig")


@query("u01_pending_changes", f"with {DIFF} select archive, change, count(*) as n from changes group by 1, 2")
def pending_changes(cat):
    return catalog_diff(cat).groupBy("archive", "change").agg(F.count("*").alias("n"))


@query("u02_vanished_years", f"with {LIVE}, {INDEXED} select i.archive, i.year, i.sessions from indexed_years i anti join (select * from live_years where year < 2000) l on i.archive = l.archive and i.year = l.year")
def vanished_years(cat):
    """Indexed years gone from a live copy that was trimmed to before 2000."""
    return rf.vanished_years(indexed_of(cat), live_of(cat).where("year < 2000"))


@query("u03_asset_diff", """select archive, asset_id, case when record_state = 'missing' then 'removed' when live_name is distinct from name or live_sha256 <> sha256 then 'updated'
  else 'unchanged' end as change from @assets""")
def asset_diff(cat):
    """Asset records as indexed against records rewritten by a scan."""
    scanned = cat.assets.where("record_state <> 'missing'").withColumns(
        {"name": F.col("live_name"), "sha256": F.col("live_sha256")})
    return rf.diff(rf.asset_signatures(cat.assets), rf.asset_signatures(scanned), ["archive", "asset_id"]).drop(
        "indexed_sig", "live_sig")


@query("j18_index_state", f"""with {LIVE}, {SEALS} select l.archive, l.year, l.run_id, i.sig is not null as indexed, i.sig = l.sig as in_sync, s.digest is not null as sealed,
  k.digest is not null as skipped_by_seal from live l left join indexed i on l.archive = i.archive and l.run_id = i.run_id
  left join seals s on l.archive = s.archive and l.year = s.year left join known_seals k on l.archive = k.archive and l.year = k.year""")
def index_state(cat):
    seals = seals_of(cat)
    return rf.session_index_state(live_of(cat), indexed_of(cat), seals, seals.where("archive <> 'AMERICA'"))


@query("n01_freshness_sweep", f"""with {DIFF}, seals as (select * from indexed_years where year <= 1997 and archive <> 'AMERICA')
select c.* from changes c anti join seals s on c.archive = s.archive and c.year = s.year where change <> 'unchanged'""")
def freshness_sweep(cat):
    seals = seals_of(cat)
    return rf.sweep(indexed_of(cat), live_of(cat), seals, seals.where("archive <> 'AMERICA'")).drop("indexed_sig", "live_sig")


@query("n01_refreshed_table", f"""with {DIFF}, seals as (select * from indexed_years where year <= 1997 and archive <> 'AMERICA'),
todo as (select c.* from changes c anti join seals s on c.archive = s.archive and c.year = s.year where change <> 'unchanged')
select archive, run_id, name, size, mtime from (select i.* from @indexed_stats i anti join todo t on i.archive = t.archive and i.run_id = t.run_id) k
union all select archive, run_id, name, size, mtime from (select l.* from @live_stats l semi join (select * from todo where change <> 'removed') t on l.archive = t.archive and l.run_id = t.run_id) f""")
def refreshed_table(cat):
    """The indexed table after the sweep: changed sessions replaced, vanished ones gone."""
    seals = seals_of(cat)
    changes = rf.sweep(indexed_of(cat), live_of(cat), seals, seals.where("archive <> 'AMERICA'"))
    columns = ["archive", "run_id", "name", "size", "mtime"]
    return rf.apply_changes(cat.indexed_stats.select(*columns), changes, cat.live_stats.select(*columns))


@query("n03_seal_years", f"""with {LIVE}, st as (select archive, year, count(*) filter (where record_state = 'unreadable' or status = 'open') as unfinished
  from @session_rows where record_state <> 'missing' group by 1, 2)
select l.archive, l.year, digest, sessions, case when l.year = {THIS_YEAR} then 'current year' when unfinished > 0 then cast(unfinished as string) || ' unfinished sessions' end as refused
from live_years l left join st on l.archive = st.archive and l.year = st.year""")
def seal_years(cat):
    folders = cat.session_rows.where("record_state <> 'missing'").select(
        "archive", "year", "run_id", F.when(F.col("record_state") == "ok", F.col("status")).alias("status"))
    return rf.seal_years(folders, live_of(cat), THIS_YEAR, "1999-06-15").drop("sealed")


# -- claims and reachability --------------------------------------------------------

@query("a12_code_claims", "select code as digest, count(*) as n_claims, min(archive || '/' || run_id || '/' || filename) as first_claimant from @sidecars where code is not null group by 1")
def code_claims(cat):
    return st.claim_counts(st.code_claims(cat.sidecars))


ASSET_CLAIMS = """claims as (select sha256 as digest, asset_id as claimant from @asset_snapshots where not pending_gc
  union all select ref_sha256, archive || '/' || run_id || '/' || filename from @edges where ref_asset is not null and ref_sha256 is not null and ref_fidelity = 'pinned')"""


@query("a12_asset_claims", f"with {ASSET_CLAIMS} select digest, count(*) as n_claims, min(claimant) as first_claimant from claims group by 1")
def asset_claims(cat):
    return st.claim_counts(st.asset_claims(cat.asset_snapshots, cat.edges))


@query("r01_dead_code", """with live as (select distinct code from @sidecars where code is not null)
select 'manifest' as kind, manifest as digest, bytes from @manifests where manifest not in (select code from live)
union all select 'blob', digest, bytes from @code_blobs where digest not in (select blob from @manifest_files where manifest in (select code from live))""")
def dead_code(cat):
    return st.dead_code(cat.manifests, cat.manifest_files, cat.code_blobs, st.code_claims(cat.sidecars))


@query("r01_dead_code_totals", """with live as (select distinct code from @sidecars where code is not null and not trashed),
dead as (select 'manifest' as kind, bytes from @manifests where manifest not in (select code from live)
  union all select 'blob', bytes from @code_blobs where digest not in (select blob from @manifest_files where manifest in (select code from live)))
select kind, count(*) as n, cast(sum(bytes) as bigint) as freed from dead group by 1""")
def dead_code_totals(cat):
    dead = st.dead_code(cat.manifests, cat.manifest_files, cat.code_blobs, st.code_claims(cat.sidecars, False))
    return dead.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("freed"))


@query("r02_dead_asset_blobs", f"with {ASSET_CLAIMS} select digest, bytes from @asset_blobs where digest not in (select digest from claims)")
def dead_asset_blobs(cat):
    """Unclaimed blobs, for a catalog whose unreadable records were repaired."""
    repaired = cat.assets.where("record_state = 'unreadable' and asset_id is null")
    return st.dead_asset_blobs(cat.asset_blobs, st.asset_claims(cat.asset_snapshots, cat.edges), repaired)


@query("r02_refused_collection", "select digest, bytes from @asset_blobs where not exists (select 1 from @assets where record_state = 'unreadable') and digest = ''")
def refused_collection(cat):
    """Nothing may go while a record cannot be read."""
    return st.dead_asset_blobs(cat.asset_blobs, st.asset_claims(cat.asset_snapshots, cat.edges),
                               cat.assets.where("record_state = 'unreadable'"))


# -- versions and caps ------------------------------------------------------------------

CAPS = """caps as (select a.archive, a.asset_id, coalesce(a.max_snapshots, r.max_snapshots) as cap_count, coalesce(a.max_snapshot_bytes, r.max_snapshot_bytes) as cap_bytes
  from @assets a join @archives r on a.archive = r.archive),
ranked as (select s.archive, s.asset_id, ord, bytes, cap_count, cap_bytes, row_number() over (partition by s.archive, s.asset_id order by ord desc) as nth
  from @asset_snapshots s join caps c on s.archive = c.archive and s.asset_id = c.asset_id where not pending_gc),
marked as (select *, cap_count > 0 and nth > cap_count as over_count from ranked),
summed as (select *, sum(bytes) over (partition by archive, asset_id order by ord desc) as total from marked where not over_count),
evicted as (select archive, asset_id, ord, bytes, over_count, cap_bytes > 0 and nth > 1 and total > cap_bytes as over_bytes from summed
  union all select archive, asset_id, ord, bytes, over_count, false from marked where over_count)"""


@query("w04_w05_snapshot_caps", f"with {CAPS} select *, over_count or over_bytes as evict from evicted")
def snapshot_caps(cat):
    return st.snapshot_caps(cat.asset_snapshots, capped_of(cat))


@query("w05_caps_applied", f"""with {CAPS} select s.archive, s.asset_id, s.ord, s.pending_gc or coalesce(e.over_count or e.over_bytes, false) as pending_gc
from @asset_snapshots s left join evicted e on s.archive = e.archive and s.asset_id = e.asset_id and s.ord = e.ord""")
def caps_applied(cat):
    return st.apply_caps(cat.asset_snapshots, capped_of(cat)).select("archive", "asset_id", "ord", "pending_gc")


@query("w06_latest_snapshots", """select archive, asset_id, max(ord) as ord, arg_max(sha256, ord) as sha256, arg_max(bytes, ord) as bytes from @asset_snapshots where not pending_gc group by 1, 2""")
def latest_snapshots(cat):
    return st.latest_snapshots(cat.asset_snapshots).select("archive", "asset_id", "ord", "sha256", "bytes")


@query("w07_changed_versions", """with v as (select archive, asset_id, ord, trigger, sha256, lag(sha256) over (partition by archive, asset_id order by ord) as before from @asset_snapshots)
select archive, asset_id, ord, trigger, sha256 from v where before is distinct from sha256""")
def changed_versions(cat):
    """Looks at each asset where the content is not that of the look before."""
    looks = cat.asset_snapshots.select("archive", "asset_id", "ord", "at_day", "trigger", "sha256")
    return st.changed_versions(looks).select("archive", "asset_id", "ord", "trigger", "sha256")


@query("a15_snapshot_counts", "select archive, asset_id, count(*) filter (where not pending_gc) as retained, count(*) as total from @asset_snapshots group by 1, 2")
def snapshot_counts(cat):
    return st.snapshot_counts(cat.asset_snapshots)


LATEST = """latest as (select archive, asset_id, arg_max(sha256, ord) as latest_sha256, arg_max(ts, ord) as latest_ts from @asset_snapshots where not pending_gc group by 1, 2),
due as (select a.*, r.manual_above, r.periodic_above, r.asset_policy, latest_sha256, coalesce(a.period_days, r.period_days) as days,
    coalesce(epoch(timestamptz '2024-01-20T00:00:00+00:00') - floor(epoch(latest_ts)) >= coalesce(a.period_days, r.period_days) * 86400, true) as due
  from @assets a join @archives r on a.archive = r.archive left join latest l on a.archive = l.archive and a.asset_id = l.asset_id)"""


def due_of(cat):
    return st.due_for_snapshot(capped_of(cat), st.latest_snapshots(snapshots_of(cat)), F.lit(ASSET_NOW).cast("timestamp"))


@query("r03_due_for_snapshot", f"with {LATEST} select archive, asset_id, days, due from due")
def due_for_snapshot(cat):
    return due_of(cat).select("archive", "asset_id", "days", "due")


@query("r04_reference_fidelity", f"""with {LATEST}, req as (select archive, run_id, filename, ref_asset as asset_id, case ref_fidelity when 'pinned' then true end as pin from @edges where ref_asset is not null)
select q.archive, q.run_id, q.filename, q.asset_id, case when live_name is null then null when coalesce(pin, {RESOLVED.replace('a.policy', 'policy')} in ('on_reference', 'every_change')
    or ({RESOLVED.replace('a.policy', 'policy')} = 'periodic' and due)) and (coalesce(pin, false) or live_size <= manual_above or coalesce(latest_sha256 = live_sha256, false)) then 'pinned' else 'observed' end as fidelity,
  case when live_name is null then 'no file' end as refused
from req q join due d on q.archive = d.archive and q.asset_id = d.asset_id""")
def reference_fidelity(cat):
    requests = cat.edges.where("ref_asset is not null").select(
        "archive", "run_id", "filename", F.col("ref_asset").alias("asset_id"),
        F.when(F.col("ref_fidelity") == "pinned", True).alias("pin"))
    return st.reference_fidelity(requests, due_of(cat)).select("archive", "run_id", "filename", "asset_id", "fidelity", "refused")


@query("r05_asset_scan", """select archive, asset_id, live_name is null as missing, live_name is not null and live_name <> name as renamed,
  live_name is not null and size <> live_size as touched, live_name is not null and size <> live_size and sha256 <> live_sha256 as changed from @assets""")
def asset_scan(cat):
    return st.scan_assets(cat.assets)


@query("j17_policy_preview", """with b as (select a.archive, a.asset_id, a.name, size, case when size >= manual_above then 'manual' when size >= periodic_above then 'periodic' else asset_policy end as was,
  case when size >= 17179869184 then 'manual' when size >= 1073741824 then 'periodic' else 'every_change' end as now from @assets a join @archives r on a.archive = r.archive where coalesce(a.policy, 'auto') = 'auto')
select * from b where was <> now""")
def policy_preview(cat):
    return st.policy_preview(cat.assets, cat.archives, {
        "periodic_above": 1024 ** 3, "manual_above": 16 * 1024 ** 3, "asset_policy": "every_change"})


@query("j19_asset_detail", "select s.archive, s.asset_id, ord, s.sha256, s.bytes, trigger, pending_gc, sha256 in (select digest from @asset_blobs) as recoverable from @asset_snapshots s")
def asset_detail(cat):
    return st.asset_detail(cat.asset_snapshots, cat.asset_blobs).select(
        "archive", "asset_id", "ord", "sha256", "bytes", "trigger", "pending_gc", "recoverable")


@query("n02_rate_limited_snapshots", """with recursive p as (select a.archive, a.asset_id, a.custkey, coalesce(a.period_days, r.period_days) as days from @assets a join @archives r on a.archive = r.archive),
looks as (select archive, asset_id, days, ts, event_id from events join p on user_id = custkey),
taken as (select archive, asset_id, days, min((ts, event_id)) as look from looks group by 1, 2, 3
  union all select t.archive, t.asset_id, t.days, (select min((l.ts, l.event_id)) from looks l where l.archive = t.archive and l.asset_id = t.asset_id and l.ts >= t.look[1] + to_days(t.days)) as look
  from taken t where t.look is not null)
select archive, asset_id, look[2] as event_id from taken where look is not null""")
def rate_limited(cat):
    """At most one snapshot per asset and period, over the whole event history."""
    looks = cat.asset_snapshots.join(capped_of(cat).select("archive", "asset_id", "days"), ["archive", "asset_id"])
    return st.rate_limited(looks, F.col("days")).drop("ts")
