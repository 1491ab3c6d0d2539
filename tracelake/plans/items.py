"""Items, sessions, filters, order and search (J1, J4, J15, W1, W8, W10, A, F, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as txt
from tracelake.operators import items as it
from tracelake.operators import search as se
from tracelake.operators.store import with_archive_settings
from tracelake.plans.registry import NOW, TODAY, query


def now():
    return F.lit(NOW).cast("timestamp")


def sessions_of(cat):
    return cat.sessions.withColumn("tags", F.array("tag_a", "tag_b"))


def annotations_of(cat):
    return cat.annotations.withColumn("tags", F.array("tag_a", "tag_b"))


def items_of(cat, verify=False):
    return it.pair_items(cat.files, cat.sidecars, verify)


def listed_of(cat):
    return it.list_sessions(sessions_of(cat), items_of(cat), now())


# The checking engine's own pairing, session list and activity.
ITEMS = """items as (
  select coalesce(f.archive, s.archive) as archive, coalesce(f.run_id, s.run_id) as run_id,
    coalesce(f.name, s.filename) as name,
    case when s.filename is null then 'orphan' when f.name is null then 'stray' else 'paired' end as status,
    case when s.filename is null then 'orphan' when f.name is null then 'stray'
      when s.sha256 <> f.sha256 then 'drifted' else 'paired' end as verified_status,
    f.size, coalesce(s.created, f.mtime) as timestamp, s.origin,
    case when s.filename is not null then case when not s.readable then '?' else coalesce(s.source, 'script') end end as source,
    s.source is not null as source_recorded, s.repo, s.commit, s.dirty, s.entry_point, s.code, s.sha256,
    coalesce(s.original_name, f.name, s.filename) as display_name, coalesce(s.duplicate_index, 0) + 1 as position
  from @files f full outer join (select * from @sidecars where not trashed) s
    on f.archive = s.archive and f.run_id = s.run_id and f.name = s.filename)"""
LISTED = ITEMS + f""", listed as (
  select s.*, coalesce(c.n, 0) as n_items, coalesce(c.p, 0) as n_problems, cast(coalesce(c.b, 0) as bigint) as bytes,
    coalesce(hold_until = 'forever' or (hold_until <> 'forever' and try_cast(hold_until as timestamptz) > timestamptz '{NOW}'), false) as held
  from @sessions s left join (select archive, run_id, count(*) as n, count(*) filter (where status <> 'paired') as p, sum(size) as b
    from items group by 1, 2) c on s.archive = c.archive and s.run_id = c.run_id)"""
ACTIVITY = LISTED + """, days as (
  select archive, cast(timezone('UTC', cast(created as timestamptz)) as date) as day, count(*) as sessions,
    cast(sum(n_items) as bigint) as items, cast(sum(n_problems) as bigint) as problems from listed group by 1, 2)"""


@query("j01_item_pairing", f"with {ITEMS} select archive, run_id, name, verified_status as status, size, timestamp, source, source_recorded, origin, display_name, position from items")
def item_pairing(cat):
    return items_of(cat, True).select("archive", "run_id", "name", "status", "size", "timestamp", "source",
                                      "source_recorded", "origin", "display_name", "position")


@query("j04_annotations", f"""with {ITEMS} select i.archive, i.run_id, i.name, coalesce(a.tag_a || '|' || a.tag_b, '') as tags,
  coalesce(a.comment, '') as comment, coalesce(s.tag_a || '|' || s.tag_b, '') as session_tags, coalesce(s.comment, '') as session_comment
from items i left join (select * from @annotations where filename is not null) a on i.archive = a.archive and i.run_id = a.run_id and i.name = a.filename
left join (select * from @annotations where filename is null) s on i.archive = s.archive and i.run_id = s.run_id""")
def annotations(cat):
    got = it.with_annotations(items_of(cat), annotations_of(cat))
    return got.select("archive", "run_id", "name", F.array_join("user_tags", "|").alias("tags"),
                      F.col("user_comment").alias("comment"),
                      F.array_join("session_user_tags", "|").alias("session_tags"), "session_comment")


@query("j15_orphan_files", """select f.archive, f.run_id, f.name, f.size from @files f anti join (select * from @sidecars where not trashed) s
  on f.archive = s.archive and f.run_id = s.run_id and f.name = s.filename""")
def orphan_files(cat):
    return it.orphan_files(cat.files, cat.sidecars).select("archive", "run_id", "name", "size")


@query("w01_duplicate_groups", f"""with {ITEMS} select archive, run_id, name, display_name, position,
  count(*) over (partition by archive, run_id, display_name) as total from items""")
def duplicate_groups(cat):
    return it.with_duplicate_groups(items_of(cat)).select(
        "archive", "run_id", "name", "display_name", "position", "total")


@query("a01_tag_counts", """select archive, tag, count(*) as n from (select archive, tag_a as tag from @sessions union all
  select archive, tag_b from @sessions) t group by 1, 2""")
def tag_counts(cat):
    return it.tag_counts(sessions_of(cat))


@query("f14_tag_vocabulary", """select archive, tag, count(*) as n from (select archive, tag_a as tag from @sessions union all
  select archive, tag_b from @sessions) t where contains(lower(tag), 'ho') group by 1, 2""")
def tag_vocabulary(cat):
    return it.tag_counts(sessions_of(cat)).where(F.lower("tag").contains("ho"))


@query("a02_session_list", f"with {LISTED} select archive, run_id, created, status, held, n_items, n_problems from listed")
def session_list(cat):
    return listed_of(cat).orderBy(*it.session_order()).select(
        "archive", "run_id", "created", "status", "held", "n_items", "n_problems")


@query("a03_activity", f"with {ACTIVITY} select archive, cast(day as string) as day, sessions, items, problems from days")
def activity(cat):
    return it.activity(listed_of(cat)).withColumn("day", F.col("day").cast("string"))


@query("a03_activity_summary", f"""with {ACTIVITY} select archive, count(*) as active_days, cast(min(day) as string) as first,
  cast(max(day) as string) as last, max(sessions) as busiest from days group by 1""")
def activity_summary(cat):
    got = it.activity_summary(it.activity(listed_of(cat)))
    return got.withColumns({n: F.col(n).cast("string") for n in ("first", "last")})


@query("a04_archive_statistics", f"""with {LISTED}
select archive, count(*) as sessions, cast(sum(n_items) as bigint) as items, cast(sum(n_problems) as bigint) as problems,
  cast(sum(bytes) as bigint) as bytes, count(*) filter (where status = 'open' and substr(created, 1, 10) <> '{TODAY}') as stale_open
from listed group by 1""")
def archive_statistics(cat):
    return listed_of(cat).groupBy("archive").agg(
        F.count("*").alias("sessions"), F.sum("n_items").alias("items"), F.sum("n_problems").alias("problems"),
        F.sum("bytes").alias("bytes"),
        F.count_if((F.col("status") == "open") & ~F.col("created").startswith(TODAY)).alias("stale_open"))


@query("a04_store_statistics", """select 'blobs' as kind, count(*) as n, cast(sum(bytes) as bigint) as bytes from @code_blobs
union all select 'manifests', count(*), cast(sum(bytes) as bigint) from @manifests""")
def store_statistics(cat):
    both = cat.code_blobs.select(F.lit("blobs").alias("kind"), "bytes").unionByName(
        cat.manifests.select(F.lit("manifests").alias("kind"), "bytes"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


COUNTED = ("sessions", "artifacts", "edges", "related_runs", "assets", "asset_snapshots")


@query("a05_row_counts", " union all ".join(f"select '{t}' as name, count(*) as n from @{t}" for t in COUNTED))
def row_counts(cat):
    out = None
    for name in COUNTED:
        one = getattr(cat, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a07_session_totals", f"with {LISTED} select archive, run_id, description, n_items, n_problems, bytes from listed")
def session_totals(cat):
    return listed_of(cat).select("archive", "run_id", "description", "n_items", "n_problems", "bytes")


@query("a09_tag_spread", """
with t as (select archive, tag_a as tag from @annotations union all select archive, tag_b from @annotations where tag_b <> tag_a),
n as (select archive, count(*) as total from @annotations group by 1)
select t.archive, tag, count(*) as n, total, count(*) = total as on_all from t join n on t.archive = n.archive group by t.archive, tag, total""")
def tag_spread(cat):
    return it.tag_spread(annotations_of(cat))


@query("a16_collection_sizes", "select archive, collection, count(*) as n from @collection_entries group by 1, 2")
def collection_sizes(cat):
    return cat.collection_entries.groupBy("archive", "collection").agg(F.count("*").alias("n"))


@query("w08_calendar_strip", f"""with {ACTIVITY},
spine as (select archive, cast(unnest(generate_series(timestamp '1999-06-19' - interval 69 day, timestamp '1999-06-19', interval 1 day)) as date) as day from @archives),
b as (select archive, max(sessions) as busiest from days group by 1)
select s.archive, cast(s.day as string) as day, coalesce(sessions, 0) as sessions, coalesce(items, 0) as items, s.day > date '{TODAY}' as future,
  case when coalesce(sessions, 0) = 0 then 0 when busiest <= 1 then 3 when sessions / busiest > 0.66 then 3 when sessions / busiest > 0.33 then 2 else 1 end as shade
from spine s left join days d on s.archive = d.archive and s.day = d.day left join b on s.archive = b.archive""")
def calendar_strip(cat):
    strip = it.calendar_strip(it.activity(listed_of(cat)), cat.archives, TODAY, 10)
    return strip.withColumn("day", F.col("day").cast("string"))


@query("w10_bucket_headers", f"""
with d as (select archive, run_id, created, cast(timezone('UTC', cast(created as timestamptz)) as date) as day from @sessions),
b as (select *, case date '{TODAY}' - day when 0 then 'Today' when 1 then 'Yesterday'
  else case when date '{TODAY}' - day < 7 then strftime(day, '%A') else strftime(day, '%B %Y') end end as bucket from d),
l as (select *, lag(bucket) over (partition by archive order by created desc, run_id desc) as before from b)
select archive, bucket, created, run_id from l where before is distinct from bucket""")
def bucket_headers(cat):
    return it.bucket_headers(cat.sessions, TODAY)


# -- filters -----------------------------------------------------------------

SHOW = ["archive", "run_id", "created", "status"]


@query("f01_session_filter", "select archive, run_id, created, status from @sessions where status = 'closed' and (tag_a = '2-HIGH' or tag_b = '2-HIGH')")
def session_filter(cat):
    return it.filter_sessions(sessions_of(cat), status="closed", tag="2-HIGH").select(*SHOW)


@query("f01_sessions_of_today", f"select archive, run_id, created, status from @sessions where substr(created, 1, 10) = '{TODAY}'")
def sessions_of_today(cat):
    return it.filter_sessions(sessions_of(cat), today=TODAY).select(*SHOW)


@query("f02_stale_open", f"select archive, run_id, created, status from @sessions where status = 'open' and cast(created as timestamptz) < timestamptz '{NOW}' - interval 24 hour")
def stale_open(cat):
    return it.stale_open(cat.sessions, now(), 24).select(*SHOW)


HELD = f"coalesce(hold_until = 'forever' or (hold_until <> 'forever' and try_cast(hold_until as timestamptz) > timestamptz '{NOW}'), false)"


@query("f03_appendable", f"select archive, run_id, created, status, status = 'open' or substr(created, 1, 10) = '{TODAY}' or {HELD} as appendable from @sessions")
def appendable(cat):
    return cat.sessions.withColumn("appendable", it.appendable(TODAY, now())).select(*SHOW, "appendable")


@query("f04_last_days", "select archive, run_id, created, status from @sessions where substr(created, 1, 10) >= '1999-05-16'")
def last_days(cat):
    return cat.sessions.where(it.within_days(TODAY, 30)).select(*SHOW)


@query("f05_session_text", "select archive, run_id, created, status from @sessions where contains(lower(run_id), 'urgent') or contains(lower(description), 'urgent') or contains(lower(tag_a), 'urgent') or contains(lower(tag_b), 'urgent')")
def session_text(cat):
    return sessions_of(cat).where(it.session_mentions("Urgent")).select(*SHOW)


@query("f06_session_gates", f"""with {LISTED} select archive, run_id, created, status from listed where status <> 'crashed' and n_problems > 0
  and cast(timezone('UTC', cast(created as timestamptz)) as date) between date '1998-01-01' and date '1998-12-31'
  and contains(lower(description || ' ' || run_id || ' ' || tag_a || ' ' || tag_b), 'building')
  and contains(lower(description || ' ' || run_id || ' ' || tag_a || ' ' || tag_b), 'high')""")
def session_gates(cat):
    return listed_of(cat).where(it.session_gates(
        "building HIGH", statuses=("open", "closed"), clean=False, day_from="1998-01-01",
        day_to="1998-12-31")).select(*SHOW)


@query("f07_date_range", f"with {ITEMS} select archive, run_id, name, timestamp from items where substr(timestamp, 1, 10) between '1997-03-01' and '1997-06-30'")
def date_range(cat):
    return items_of(cat).where(it.in_date_range(F.col("timestamp"), "1997-03-01", "1997-06-30")).select(
        "archive", "run_id", "name", "timestamp")


@query("f10_source_facets", f"with {ITEMS} select archive, run_id, name from items where not source_recorded or source = 'external'")
def source_facets(cat):
    facet = txt.source_facet(F.col("source"), F.col("source_recorded"))
    return items_of(cat).where(se.facet_condition(facet, ["external", "unrecorded"])).select(
        "archive", "run_id", "name")


@query("f11_any_column", """select archive, run_id, created, status, description from @sessions where contains(lower(concat_ws('~', archive, run_id, year, created, status,
  tag_a, tag_b, description, hold_until, record_id, rel_path, merged_note, adopted_note)), '199')""")
def any_column(cat):
    return it.any_column_contains(cat.sessions, "199").select(*SHOW, "description")


RESOLVED = """case when coalesce(a.policy, '') in ('', 'auto') then case when size >= manual_above then 'manual'
  when size >= periodic_above then 'periodic' else asset_policy end
  when a.policy in ('every_change', 'on_reference', 'periodic', 'manual') then a.policy else 'on_reference' end"""


@query("f12_asset_filter", f"""select a.archive, a.asset_id, a.name, size from @assets a join @archives r on a.archive = r.archive
where {RESOLVED} = 'periodic' and contains(lower(a.asset_id || ' ' || a.name), 'svg')""")
def asset_filter(cat):
    got = with_archive_settings(cat.assets, cat.archives)
    named = F.lower(F.concat_ws(" ", "asset_id", "name")).contains("svg")
    return got.where((F.col("resolved") == "periodic") & named).select("archive", "asset_id", "name", "size")


@query("f13_status_filter", f"with {ITEMS} select archive, run_id, name, verified_status as status from items where verified_status in ('stray', 'drifted')")
def status_filter(cat):
    return items_of(cat, True).where(F.col("status").isin("stray", "drifted")).select(
        "archive", "run_id", "name", "status")


@query("f15_unmerged_sessions", "select archive, run_id from @sessions where merged_note is null")
def unmerged_sessions(cat):
    from tracelake.operators.transfer import history_of, merged_note
    return history_of(cat).where(merged_note(F.col("history")).isNull()).select("archive", "run_id")


@query("f16_previewable", """select archive, asset_id, name, size from @assets where (name like '%.svg' or name like '%.png') and size <= 2097152
union all select archive, run_id || '/' || name, name, size from @files where name like '%.svg' and size <= 2097152""")
def previewable(cat):
    both = cat.assets.select("archive", "asset_id", "name", "size").unionByName(cat.files.select(
        "archive", F.concat_ws("/", "run_id", "name").alias("asset_id"), "name", "size"))
    return both.where(txt.previewable(F.col("name"), F.col("size")))


# -- order and paging ---------------------------------------------------------

@query("o01_item_order", f"with {ITEMS} select archive, run_id, name, timestamp from items")
def item_order(cat):
    return items_of(cat).orderBy(*it.item_order()).select("archive", "run_id", "name", "timestamp")


@query("o02_item_order_by_status", f"with {ITEMS} select archive, run_id, name, verified_status as status from items")
def item_order_by(cat):
    return items_of(cat, True).orderBy(*it.item_order_by("status", False)).select(
        "archive", "run_id", "name", "status")


@query("o03_session_order", "select archive, run_id, created from @sessions")
def session_order(cat):
    return cat.sessions.orderBy(*it.session_order(False)).select("archive", "run_id", "created")


@query("o04_asset_order", "select archive, asset_id, scanned_at, created from @assets")
def asset_order(cat):
    return cat.assets.orderBy(*it.asset_order()).select("archive", "asset_id", "scanned_at", "created")


@query("o05_limit_with_flag", f"""with {ITEMS} select archive, run_id, name, count(*) over () > 500 as truncated from items
order by cast(timestamp as timestamptz) desc nulls last, display_name, position, archive, run_id, name limit 500""")
def limit_with_flag(cat):
    order = [*it.item_order(), F.asc("archive"), F.asc("run_id"), F.asc("name")]
    return it.limited(items_of(cat), order, 500).select("archive", "run_id", "name", "truncated")


@query("o06_table_page", """select archive, run_id, created, status, (select count(*) from @sessions where status = 'crashed') as total from @sessions
where status = 'crashed' order by created desc, archive, run_id limit 200 offset 400""")
def table_page(cat):
    found = cat.sessions.where("status = 'crashed'")
    shown = it.page(found, [F.desc("created"), F.asc("archive"), F.asc("run_id")], 200, 400)
    total = found.groupBy("status").agg(F.count("*").alias("total"))
    return shown.join(total, "status").select(*SHOW, "total")


# -- search ---------------------------------------------------------------------

CORPUS = ITEMS + """, corpus as (select i.*, s.tag_a as st_a, s.tag_b as st_b, s.description, s.created as session_created,
    a.tag_a as ut_a, a.tag_b as ut_b, coalesce(a.comment, '') as user_comment, n.tag_a as nt_a, n.tag_b as nt_b, coalesce(n.comment, '') as session_comment
  from items i join @sessions s on i.archive = s.archive and i.run_id = s.run_id
  left join (select * from @annotations where filename is not null) a on i.archive = a.archive and i.run_id = a.run_id and i.name = a.filename
  left join (select * from @annotations where filename is null) n on i.archive = n.archive and i.run_id = n.run_id)"""


def _search(cat, query_text, **kw):
    return se.search_items(items_of(cat), sessions_of(cat), annotations_of(cat), query_text, **kw)


@query("f08_search_clauses", f"""with {CORPUS} select archive, run_id, name from corpus
where name like 'line-_%' and (lower(st_a) = '2-high' or lower(st_b) = '2-high')
  and contains(lower(name || '~' || st_a || '~' || st_b || '~' || coalesce(origin, '') || '~' || coalesce(source, '') || '~' || run_id || '~' || description
  || '~' || coalesce(ut_a || '~' || ut_b, '') || '~' || coalesce(nt_a || '~' || nt_b, '') || '~' || user_comment || '~' || session_comment), 'lab-1')""")
def search_clauses(cat):
    """Quoted, scoped and bare clauses together, over the whole corpus."""
    return _search(cat, "file:\"line-?*\" LAB-1 tag:'2-h*'", limit=None).select("archive", "run_id", "name")


@query("f09_search", f"""with {CORPUS} select archive, run_id, name, count(*) over () > 1000 as truncated from corpus
where (source = 'external' and source_recorded) and substr(timestamp, 1, 10) between '1996-01-01' and '1998-12-31'
  and (contains(lower(user_comment), 'shipped') or contains(lower(session_comment), 'shipped')) and (lower(ut_a) like 'disc%' or lower(ut_b) like 'disc%'
    or lower(nt_a) like 'disc%' or lower(nt_b) like 'disc%')
order by session_created desc, run_id desc, archive, cast(timestamp as timestamptz) desc nulls last, display_name, position, name limit 1000""")
def search(cat):
    return _search(cat, "comment:shipped utag:'DISC*'", date_from="1996-01-01", date_to="1998-12-31",
                   sources=["external"]).select("archive", "run_id", "name", "truncated")


@query("v01_saved_search", f"""with {CORPUS} select archive, run_id, name, count(*) over () > 250 as truncated from corpus
where (contains(lower(name), 'svg') or contains(lower(st_a), 'svg') or contains(lower(st_b), 'svg'))
order by session_created desc, run_id desc, archive, cast(timestamp as timestamptz) desc nulls last, display_name, position, name limit 250""")
def saved_search(cat):
    stored = {"name": "figures", "query": "svg", "fields": ["filename", "tags"]}
    return se.run_saved_search(stored, items_of(cat), sessions_of(cat), annotations_of(cat), 250).select(
        "archive", "run_id", "name", "truncated")


@query("s14_search_summary", f"""with {CORPUS}, hits as (select * from corpus where lower(coalesce(origin, '')) = 'lab-7' or lower(coalesce(source, '')) = 'lab-7'),
readable as (select i.archive, count(*) as n from items i semi join @sessions s on i.archive = s.archive and i.run_id = s.run_id group by 1)
select s.archive, count(*) as n_sessions, any_value(coalesce(r.n, 0)) as n_scanned, any_value(coalesce(h.n, 0)) as n_hits, false as truncated
from @sessions s left join readable r on s.archive = r.archive left join (select archive, count(*) as n from hits group by 1) h on s.archive = h.archive group by 1""")
def search_summary(cat):
    found = _search(cat, "origin:'LAB-7'", limit=None)
    return se.search_summary(items_of(cat), sessions_of(cat), found)


@query("v02_save_searches", """
with inc as (select 'EUROPE' as archive, 'brand-' || cast(p_brand as string) as raw, p_brand from part group by p_brand),
old as (select 'EUROPE' as archive, p_type as name, 'old ' || p_type as title from part group by p_type),
new as (select 'EUROPE' as archive, case when p_type = 'PROMO' then 'not valid!' else p_type end as name, '' as title, 'tag:' || lower(p_type) as query from part group by p_type
  union all select 'EUROPE', replace(p_brand, '#', '-'), p_brand, 'file:' || p_brand from part group by p_brand)
select archive, name, title, query, created, modified from (
  select n.archive, n.name, coalesce(nullif(n.title, ''), o.title, '') as title, query, coalesce(case when o.name is not null then '1998-01-01' end, '1999-06-15T12:00:00+00:00') as created,
    '1999-06-15T12:00:00+00:00' as modified from new n left join old o on n.archive = o.archive and n.name = o.name where n.name <> 'not valid!'
  union all select archive, name, title, 'kept', '1998-01-01', '1998-01-01' from old where name = 'PROMO') u""")
def save_searches(cat):
    part = cat.part
    old = part.select(F.lit("EUROPE").alias("archive"), F.col("p_type").alias("name")).distinct().select(
        "archive", "name", F.concat(F.lit("old "), "name").alias("title"), F.lit("kept").alias("query"),
        F.lit("").alias("fields"), F.lit(None).cast("string").alias("date_from"),
        F.lit(None).cast("string").alias("date_to"), F.lit("1998-01-01").alias("created"),
        F.lit("1998-01-01").alias("modified"))
    types = part.select("p_type").distinct().select(
        F.lit("EUROPE").alias("archive"),
        F.when(F.col("p_type") == "PROMO", "not valid!").otherwise(F.col("p_type")).alias("name"),
        F.lit("").alias("title"), F.concat(F.lit("tag:"), F.lower("p_type")).alias("query"))
    brands = part.select("p_brand").distinct().select(
        F.lit("EUROPE").alias("archive"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("name"),
        F.col("p_brand").alias("title"), F.concat(F.lit("file:"), "p_brand").alias("query"))
    new = types.unionByName(brands).select("*", F.lit("").alias("fields"),
                                           F.lit(None).cast("string").alias("date_from"),
                                           F.lit(None).cast("string").alias("date_to"))
    table, _refused = se.save_searches(old, new, NOW)
    return table.select("archive", "name", "title", "query", "created", "modified")
