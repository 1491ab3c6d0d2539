"""Batch changes, collections and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import changes as ch
from tracelake.operators import people as pe
from tracelake.operators.lineage import NODE
from tracelake.plans.items import HELD, annotations_of, now, sessions_of
from tracelake.plans.registry import NOW, TODAY, query

NO = "cast(null as string)"
SESSION = ["archive", "run_id"]


@query("f17_writable_archives", """select s.archive, s.run_id, case when kind = 'fragment' then 'fragment: not ours to change' else 'locked since its merge' end as refused
from @sessions s join @archives a on s.archive = a.archive where kind = 'fragment' or merged_at <> ''""")
def writable_archives(cat):
    """Changes to every session that must be refused, with the reason."""
    return ch.split_writable(cat.sessions.select(*SESSION), cat.archives)[1].select(*SESSION, "refused")


@query("m01_annotate", """
with c as (select archive, run_id, filename, case when source = 'external' then 'external' when source = 'script' then 'a,b' end as add_tag, 'seen' as line from @sidecars where readable and not trashed),
good as (select * from c where add_tag is null or add_tag = 'external'),
old as (select archive, run_id, filename, tag_a, tag_b, comment from @annotations)
select coalesce(o.archive, g.archive) as archive, coalesce(o.run_id, g.run_id) as run_id, coalesce(o.filename, g.filename) as filename,
  array_to_string(list_filter([case when tag_a <> 'disc 1' or g.run_id is null then tag_a end, case when tag_b <> tag_a then tag_b end, add_tag], lambda x: x is not null), '|') as tags,
  array_to_string(list_filter([comment, line], lambda x: x is not null), '~') as comment
from old o full outer join good g on o.archive = g.archive and o.run_id = g.run_id and o.filename = g.filename""")
def annotate(cat):
    """Every recorded file gets a tag and a line; the bad tags are left out."""
    none = F.lit(None)
    changes = cat.sidecars.where("readable and not trashed").select(
        *NODE, F.when(F.col("source") == "external", F.array(F.lit("external")))
        .when(F.col("source") == "script", F.array(F.lit("a,b"))).alias("add_tags"),
        F.array(F.lit("disc 1")).alias("remove_tags"), none.cast("array<string>").alias("set_tags"),
        F.lit(" seen ").alias("append_comment"), none.cast("string").alias("set_comment"))
    table, _refused = ch.annotate(annotations_of(cat), changes)
    return table.select(*NODE, F.array_join("tags", "|").alias("tags"), F.replace("comment", F.lit("\n"), F.lit("~")).alias("comment"))


@query("m01_refused_annotations", "select archive, run_id, filename, 'unusable tag: a,b' as refused from @sidecars where readable and not trashed and source = 'script'")
def refused_annotations(cat):
    changes = cat.sidecars.where("readable and not trashed").select(
        *NODE, F.when(F.col("source") == "script", F.array(F.lit("ok"), F.lit("a,b"))).alias("add_tags"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("remove_tags", "array<string>"), ("set_tags", "array<string>"),
                                                   ("append_comment", "string"), ("set_comment", "string"))])
    return ch.annotate(annotations_of(cat), changes)[1].select(*NODE, "refused")


@query("m01_ordered_changes", """
with c as (select archive, run_id, filename, line, flag from @artifacts where has_sidecar and readable and not trashed),
old as (select archive, run_id, filename, tag_a, tag_b, comment from @annotations where filename is not null)
select coalesce(c.archive, o.archive) as archive, coalesce(c.run_id, o.run_id) as run_id, coalesce(c.filename, o.filename) as filename,
  array_to_string(case when c.filename is null then list_filter([tag_a, case when tag_b <> tag_a then tag_b end], lambda x: x is not null)
    when line = 4 then ['late'] when line = 3 and flag <> 'R' then ['one', 'two', 'late']
    else list_filter([tag_a, case when tag_b <> tag_a then tag_b end, 'two', 'late'], lambda x: x is not null) end, '|') as tags,
  case when c.filename is null then comment when line = 4 then 'anew~third' else array_to_string(list_filter([comment, 'first', case when flag <> 'R' then 'second' end, 'third'], lambda x: x is not null), '~') end as comment
from c full outer join old o on c.archive = o.archive and c.run_id = o.run_id and c.filename = o.filename""")
def ordered_changes(cat):
    """Three changes of every recorded file, each built on the one before; one that is refused leaves the others."""
    none, tags = F.lit(None), lambda *x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    rows = cat.artifacts.where("has_sidecar and readable and not trashed").select(*NODE, "line", "flag")
    change = lambda n, add=none, remove=none, put=none, append=none, anew=none: F.struct(
        F.lit(n).alias("ord"), add.cast("array<string>").alias("add_tags"), remove.cast("array<string>").alias("remove_tags"),
        put.cast("array<string>").alias("set_tags"), append.cast("string").alias("append_comment"), anew.cast("string").alias("set_comment"))
    three = F.array(
        change(1, tags("one", "two"), append=F.lit("first")),
        change(2, F.when(F.col("flag") == "R", tags("a,b")).otherwise(tags("two")), F.when(F.col("line") != 3, tags("one")),
               F.when(F.col("line") == 3, tags("one")), F.lit("second")),
        change(3, tags("late"), F.when(F.col("flag") == "R", tags("one")), F.when(F.col("line") == 4, tags()), F.lit("third"),
               F.when(F.col("line") == 4, "anew")))
    table, _refused = ch.annotate(annotations_of(cat).where("filename is not null"), rows.select(*NODE, F.inline(three)))
    return table.select(*NODE, F.array_join("tags", "|").alias("tags"), F.replace("comment", F.lit("\n"), F.lit("~")).alias("comment"))


@query("m02_reseal", """select c.archive, c.run_id, c.filename, 'reseal' as action, c.sha256 as old_sha256, f.sha256 as new_sha256 from (select * from @sidecars where readable and not trashed) c
join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where c.sha256 is distinct from f.sha256""")
def reseal(cat):
    """Log of accepting every edited file as it is now."""
    cars = cat.sidecars.where("readable and not trashed")
    return ch.reseal(cars, cat.files, cars.select(*NODE))[1]


@query("m02_refused_reseals", """select f.archive, f.run_id, f.name as filename, 'no sidecar' as refused from @files f anti join (select * from @sidecars where not trashed) c
  on f.archive = c.archive and f.run_id = c.run_id and f.name = c.filename""")
def refused_reseals(cat):
    asked = cat.files.select(*SESSION, F.col("name").alias("filename"))
    return ch.reseal(cat.sidecars.where("not trashed"), cat.files, asked)[2]


RENAMING = """changes as (select archive, run_id, filename as old_name, case when source = 'external' then 'ext-' || filename when source = 'script' then 'line-1.csv' else filename || '.meta.json' end as new_name
  from @sidecars where readable and not trashed),
wanted as (select archive, run_id, new_name, count(*) as n from changes group by 1, 2, 3),
judged as (select c.*, case when f.name is null then 'no such artifact' when c.new_name like '%.meta.json' then 'not_an_artifact_name' when c.new_name = c.old_name then 'same_name'
    when u.name is not null then 'name in use' when w.n > 1 then 'wanted twice' end as refused
  from changes c left join @files f on c.archive = f.archive and c.run_id = f.run_id and c.old_name = f.name left join @files u on c.archive = u.archive and c.run_id = u.run_id and c.new_name = u.name
  join wanted w on c.archive = w.archive and c.run_id = w.run_id and c.new_name = w.new_name)"""


def renamed_of(cat):
    changes = cat.sidecars.where("readable and not trashed").select(
        *SESSION, F.col("filename").alias("old_name"),
        F.when(F.col("source") == "external", F.concat(F.lit("ext-"), "filename")).when(F.col("source") == "script", "line-1.csv")
        .otherwise(F.concat("filename", F.lit(".meta.json"))).alias("new_name"))
    return ch.rename_files(cat.files, cat.sidecars, cat.edges, cat.renames, changes, "all")


@query("m03_renamed_files", f"with {RENAMING} select f.archive, f.run_id, coalesce(j.new_name, f.name) as name, f.size from @files f left join (select * from judged where refused is null) j on f.archive = j.archive and f.run_id = j.run_id and f.name = j.old_name")
def renamed_files(cat):
    return renamed_of(cat)["files"].select("archive", "run_id", "name", "size")


@query("m03_renamed_edges", f"""with {RENAMING}, done as (select * from judged where refused is null)
select e.archive, e.run_id, coalesce(o.new_name, e.filename) as filename, e.ord, e.ref_archive, e.ref_session, coalesce(case when e.ref_asset is null then d.new_name end, e.ref_file) as ref_file
from @edges e left join done d on coalesce(e.ref_archive, e.archive) = d.archive and coalesce(e.ref_session, e.run_id) = d.run_id and e.ref_file = d.old_name and e.ref_asset is null
left join done o on e.archive = o.archive and e.run_id = o.run_id and e.filename = o.old_name""")
def renamed_edges(cat):
    return renamed_of(cat)["edges"].select(*NODE, "ord", "ref_archive", "ref_session", "ref_file")


@query("m03_rename_log", f"""with {RENAMING}, last as (select archive, run_id, max(ord) as top from @renames group by 1, 2)
select archive, run_id, ord, old_name, new_name from @renames
union all select j.archive, j.run_id, cast(coalesce(top, -1) + row_number() over (partition by j.archive, j.run_id order by old_name) as int), old_name, new_name
from judged j left join last l on j.archive = l.archive and j.run_id = l.run_id where refused is null""")
def rename_log(cat):
    """The log afterwards: new entries follow each session's last one."""
    return renamed_of(cat)["renames"].select(*SESSION, F.col("ord").cast("int").alias("ord"), "old_name", "new_name")


@query("m03_rename_history", f"""with {RENAMING} select archive, run_id, 'renamed' as action, '{NOW}' as at, 'me@example.org' as by, new_name as file, old_name || ' -> ' || new_name as note
from judged where refused is null""")
def rename_history(cat):
    return ch.rename_history(renamed_of(cat)["done"], NOW, "me@example.org")


@query("m04_adoption_history", f"""select f.archive, f.run_id, 'reconcile' as action, '{NOW}' as at, 'me@example.org' as by, f.name as file, cast(null as string) as note from @files f
anti join (select * from @sidecars where not trashed) c on f.archive = c.archive and f.run_id = c.run_id and f.name = c.filename""")
def adoption_history(cat):
    return ch.adoption_history(ch.adopt_orphans(cat.files, cat.sidecars, NOW, "me@example.org"), NOW, "me@example.org")


@query("m03_refused_renames", f"with {RENAMING} select archive, run_id, old_name, new_name, refused from judged where refused is not null")
def refused_renames(cat):
    return renamed_of(cat)["refused"]


@query("m04_adopted_orphans", f"""select f.archive, f.run_id, f.name as filename, '{NOW}' as created, 'external' as source, f.sha256, true as reconciled from @files f
anti join (select * from @sidecars where not trashed) c on f.archive = c.archive and f.run_id = c.run_id and f.name = c.filename""")
def adopted_orphans(cat):
    return ch.adopt_orphans(cat.files, cat.sidecars, NOW, "me@example.org").drop("origin", "imported_by")


INCOMING = """incoming as (select archive, run_id, display_name as requested, size, actual_sha256 as sha256, created, partkey, suppkey from @artifacts where flag = 'R')"""


def imported_of(cat):
    incoming = cat.artifacts.where("flag = 'R'").select(
        "archive", "run_id", F.col("display_name").alias("requested"), "size", F.col("actual_sha256").alias("sha256"),
        "created", "partkey", "suppkey")
    return ch.import_rows(incoming, cat.sessions, cat.files, ["created", "partkey", "suppkey", "size", "sha256"],
                          F.substring("created", 1, 10), TODAY, now(), "cancel")


OPENED = f"""{INCOMING}, judged as (select i.*, case when s.run_id is null then 'no such session' when not (s.status = 'open' or substr(s.created, 1, 10) = '{TODAY}' or {HELD.replace('hold_until', 's.hold_until')}) then 'session is frozen' end as no_entry
  from incoming i left join @sessions s on i.archive = s.archive and i.run_id = s.run_id),
ranked as (select *, row_number() over (partition by archive, run_id, requested, no_entry is null order by created, partkey, suppkey, size, sha256) as nth from judged),
placed as (select r.*, coalesce(no_entry, case when nth > 1 or f.name is not null then 'name already taken' end) as refused from ranked r left join @files f on r.archive = f.archive and r.run_id = f.run_id and r.requested = f.name)"""


@query("m05_imported_rows", f"with {OPENED} select archive, run_id, requested as filename, size, sha256, 'external' as source from placed where refused is null")
def imported_rows(cat):
    return imported_of(cat)[0].select("archive", "run_id", "filename", "size", "sha256", "source")


@query("m05_import_history", f"""with {OPENED} select archive, run_id, 'import' as action, '{NOW}' as at, cast(null as string) as by, requested as file, 'scan ' || cast(size as string) as note
from placed where refused is null""")
def import_history(cat):
    placed = imported_of(cat)[0].withColumn("origin", F.concat(F.lit("scan "), F.col("size").cast("string")))
    return ch.import_history(placed, NOW)


@query("m05_refused_imports", f"with {OPENED} select archive, run_id, requested, refused, count(*) as n from placed where refused is not null group by 1, 2, 3, 4")
def refused_imports(cat):
    return imported_of(cat)[1].groupBy("archive", "run_id", "requested", "refused").agg(F.count("*").alias("n"))


DELETING = """asked as (select archive, run_id, filename from @sidecars where readable and not trashed and source = 'external'),
needed as (select archive, coalesce(ref_session, run_id) as run_id, ref_file as filename, count(*) as broken from @edges where ref_archive is null and ref_asset is null and ref_file is not null group by 1, 2, 3),
judged as (select a.*, coalesce(broken, 0) as broken_links from asked a left join needed n on a.archive = n.archive and a.run_id = n.run_id and a.filename = n.filename)"""


def asked_of(cat):
    return cat.sidecars.where("readable and not trashed and source = 'external'").select(*NODE)


@query("m06_guarded_delete", f"with {DELETING} select j.archive, j.run_id, j.filename, 'delete' as action, c.sha256, broken_links from judged j join @sidecars c on j.archive = c.archive and j.run_id = c.run_id and j.filename = c.filename where broken_links = 0")
def guarded_delete(cat):
    return ch.delete_files(cat.files, cat.sidecars, cat.edges, asked_of(cat))[0]


@query("m06_refused_deletes", f"with {DELETING} select archive, run_id, filename, 'still derived from' as refused from judged where broken_links > 0")
def refused_deletes(cat):
    return ch.delete_files(cat.files, cat.sidecars, cat.edges, asked_of(cat))[1]


@query("m06_deleted_sessions", """with inb as (select archive, ref_session as run_id from @edges where ref_archive is null and ref_asset is null and ref_session <> run_id
  union all select archive, ref_session from @related_runs where ref_archive is null and ref_session <> run_id), n as (select archive, run_id, count(*) as n from inb group by 1, 2)
select s.archive, s.run_id, coalesce(n, 0) as broken_links, 'delete-session' as action from @sessions s left join n on s.archive = n.archive and s.run_id = n.run_id where status = 'crashed' and coalesce(n, 0) = 0""")
def deleted_sessions(cat):
    return ch.delete_sessions(cat.sessions, cat.edges, cat.related_runs, cat.sessions.where("status = 'crashed'"))[0]


@query("m07_replaced_content", f"""with ok as (select c.archive, c.run_id, c.filename, f.sha256 as bytes from @sidecars c join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where readable and not trashed and source = 'script')
select s.archive, s.run_id, s.filename, case when o.run_id is null then s.source else 'external' end as source, case when o.run_id is null then s.origin else 'rerun' end as origin,
  case when o.run_id is null then s.sha256 else sha256(s.filename) end as sha256, case when o.run_id is not null then coalesce(s.sha256, bytes) end as replaced_sha256
from (select * from @sidecars where readable and not trashed) s left join ok o on s.archive = o.archive and s.run_id = o.run_id and s.filename = o.filename""")
def replaced_content(cat):
    cars = cat.sidecars.where("readable and not trashed")
    changes = cars.where("source = 'script'").select(*NODE, F.sha2("filename", 256).alias("new_sha256"), F.lit("rerun").alias("origin"))
    return ch.replace_content(cars, cat.files, changes, NOW)[0].select(*NODE, "source", "origin", "sha256", "replaced_sha256")


@query("m07_replace_history", f"""select c.archive, c.run_id, 'replace' as action, '{NOW}' as at, cast(null as string) as by, c.filename as file,
  coalesce(c.sha256, f.sha256) || ' -> ' || sha256(c.filename) as note
from @sidecars c join @files f on c.archive = f.archive and c.run_id = f.run_id and c.filename = f.name where readable and not trashed and source = 'script'""")
def replace_history(cat):
    cars = cat.sidecars.where("readable and not trashed")
    changes = cars.where("source = 'script'").select(*NODE, F.sha2("filename", 256).alias("new_sha256"), F.lit("rerun").alias("origin"))
    return ch.replace_history(ch.replace_content(cars, cat.files, changes, NOW)[0], NOW)


@query("m08_holds", """select archive, run_id, case when status = 'open' then null when tag_a = '1-URGENT' then '1999-06-15T14:00:00+00:00' when tag_a = '2-HIGH' then 'forever' else hold_until end as hold_until from @sessions""")
def holds(cat):
    """Open sessions released, urgent ones held for two hours, high ones for good."""
    changes = sessions_of(cat).where("status = 'open' or tag_a in ('1-URGENT', '2-HIGH')").select(
        *SESSION, (F.col("status") == "open").alias("release"),
        F.when(F.col("tag_a") == "1-URGENT", 7200).alias("seconds"))
    return ch.hold_sessions(cat.sessions, changes, now())[0].select(*SESSION, "hold_until")


@query("m09_redirected_refs", """with w as (select archive, run_id, display_name as requested, arg_max(filename, duplicate_index) as actual from @artifacts where duplicate_index is not null group by 1, 2, 3)
select e.archive, e.run_id, e.filename, e.ord, case when ref_archive is null and ref_session is null and ref_asset is null then coalesce(actual, ref_file) else ref_file end as ref_file
from @edges e left join w on e.archive = w.archive and e.run_id = w.run_id and e.ref_file = w.requested""")
def redirected_refs(cat):
    """Bare references follow the name the same batch really wrote."""
    written = cat.artifacts.where("duplicate_index is not null").select(
        *SESSION, F.col("display_name").alias("requested"), "filename", "duplicate_index")
    return ch.redirect_refs(cat.edges, written).select(*NODE, "ord", "ref_file")


@query("m10_policies", """select archive, asset_id, case when size > 5000000000 and policy = 'auto' then 'periodic' else policy end as policy,
  case when size > 5000000000 then null else period_days end as period_days, case when size > 5000000000 and coalesce(policy, '') <> 'sometimes' then 9 else max_snapshots end as max_snapshots from (select archive, asset_id, size, policy, max_snapshots,
  case when coalesce(policy, '') = 'sometimes' and size > 5000000000 then period_days else period_days end as period_days, policy as p from @assets where coalesce(policy, '') <> 'sometimes') a
union all select archive, asset_id, policy, period_days, max_snapshots from @assets where policy = 'sometimes'""")
def policies(cat):
    """Large assets: automatic ones become periodic, periods cleared, nine versions kept."""
    changes = cat.assets.where("size > 5000000000").select(
        "archive", "asset_id", F.when(F.col("policy") == "auto", "periodic").when(F.col("policy") == "sometimes", "sometimes").alias("new_policy"),
        F.lit(-1).alias("new_period_days"), F.lit(9).alias("new_max_snapshots"), F.lit(None).cast("bigint").alias("new_max_snapshot_bytes"))
    return ch.set_policies(cat.assets, changes)[0].select("archive", "asset_id", "policy", "period_days", "max_snapshots")


REGISTERED = """inc as (select 'EUROPE' as archive, 'doc-' || cast(doc_id as string) || '.txt' as name, n_chars * 100000 as size, sha256(text) as sha256,
    case lang when 'en' then null when 'fr' then 'auto' when 'de' then 'manual' else 'sometimes' end as policy, doc_id from documents),
good as (select i.*, coalesce((select max(cast(substr(asset_id, 7) as bigint)) from @assets where archive = 'EUROPE'), 0) + row_number() over (order by doc_id) as n from inc i where policy is null or policy <> 'sometimes'),
made as (select g.*, 'AF-24-' || lpad(cast(n as string), greatest(4, length(cast(n as string)))::int, '0') as asset_id, case when policy = 'manual' or size >= manual_above then 'manual' when size >= periodic_above then 'periodic' else 'manual' end as resolved, manual_above
  from good g join @archives r on g.archive = r.archive)"""


def registered_of(cat):
    incoming = cat.documents.select(
        F.lit("EUROPE").alias("archive"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        (F.col("n_chars") * 100000).alias("size"), F.sha2("text", 256).alias("sha256"),
        F.when(F.col("lang") == "fr", "auto").when(F.col("lang") == "de", "manual").when(F.col("lang") == "es", "sometimes").alias("policy"), "doc_id")
    return ch.register_assets(incoming, cat.assets, cat.archives, 24, ["doc_id"], F.floor(F.col("doc_id") / 1000), NOW)


@query("m11_registered_assets", f"with {REGISTERED} select archive, asset_id, name, size, sha256, coalesce(policy, 'auto') as policy, '{NOW}' as created from made")
def registered_assets(cat):
    return registered_of(cat)[0]


@query("m11_first_snapshots", f"with {REGISTERED} select archive, asset_id, sha256, size as bytes from made where resolved <> 'manual' and size <= manual_above")
def first_snapshots(cat):
    return registered_of(cat)[1].select("archive", "asset_id", "sha256", "bytes")


@query("m12_appended_related_runs", """with add_rows as (select archive, run_id, case when tag_a = '5-LOW' then 'a|b|c' else 'S-' || substr(run_id, 3) end as ref from @sessions
  union all select archive, run_id, ref_session from @related_runs where ref_archive is null)
select distinct a.archive, a.run_id, ref as ref_session from add_rows a anti join (select * from @related_runs where ref_archive is null) r on a.archive = r.archive and a.run_id = r.run_id and a.ref = r.ref_session where ref <> 'a|b|c'""")
def appended_related_runs(cat):
    """New session links; those recorded already are not added twice."""
    own = sessions_of(cat).select(*SESSION, F.when(F.col("tag_a") == "5-LOW", "a|b|c").otherwise(
        F.concat(F.lit("S-"), F.expr("substring(run_id, 3)"))).alias("ref"))
    again = cat.related_runs.where("ref_archive is null").select(*SESSION, F.col("ref_session").alias("ref"))
    added, _bad = ch.append_refs(cat.related_runs, own.unionByName(again), key=SESSION, distinct=True)
    return added.where("ref_session is not null").select(*SESSION, "ref_session")


@query("m12_appended_lineage", """select archive, run_id, filename, display_name as ref_file from @artifacts where has_sidecar and flag = 'A' and line <> 2""")
def appended_lineage(cat):
    written = cat.artifacts.where("has_sidecar and flag = 'A'").select(
        *NODE, F.when(F.col("line") == 2, "x/").otherwise(F.col("display_name")).alias("ref"))
    return ch.append_refs(cat.edges, written)[0].select(*NODE, "ref_file")


# -- U6 -----------------------------------------------------------------------------

ADDING = """adds as (select cal_archive as archive, p_brand as collection, case p_type when 'ECONOMY' then 'collections/' || p_brand when 'LARGE' then cal_archive || '|' || cal_session || '/' || cal_file
    when 'MEDIUM' then cal_session when 'PROMO' then 'x||y' else cal_session || '/' || cal_file end as ref from part join @calibrations on p_partkey = cal_part),
old as (select archive, collection, ref from @collection_entries),
refusals as (select a.*, case when a.ref = 'x||y' then 'multiple_archive_separators' when a.ref = 'collections/' || a.collection then 'contains itself' when o.ref is not null then 'already there' end as refused
  from adds a left join (select distinct archive, collection, ref from old) o on a.archive = o.archive and a.collection = o.collection and a.ref = o.ref)"""


def additions_of(cat):
    kind = F.col("p_type")
    named = F.concat_ws("/", "cal_session", "cal_file")
    return cat.part.join(cat.calibrations, F.col("p_partkey") == F.col("cal_part")).select(
        F.col("cal_archive").alias("archive"), F.col("p_brand").alias("collection"),
        F.when(kind == "ECONOMY", F.concat(F.lit("collections/"), "p_brand"))
        .when(kind == "LARGE", F.concat(F.col("cal_archive"), F.lit("|"), named)).when(kind == "MEDIUM", F.col("cal_session"))
        .when(kind == "PROMO", "x||y").otherwise(named).alias("ref"))


@query("u06_added_entries", f"with {ADDING} select distinct archive, collection, ref from refusals where refused is null")
def added_entries(cat):
    return ch.add_entries(cat.collection_entries, additions_of(cat))[0]


@query("u06_refused_entries", f"with {ADDING} select archive, collection, ref, refused from refusals where refused is not null")
def refused_entries(cat):
    return ch.add_entries(cat.collection_entries, additions_of(cat))[1]


@query("u06_removed_entries", f"with {ADDING} select e.* from @collection_entries e anti join adds a on e.archive = a.archive and e.collection = a.collection and (e.ref = a.ref) and a.ref <> 'x||y'")
def removed_entries(cat):
    return ch.remove_entries(cat.collection_entries, additions_of(cat).where("ref <> 'x||y'"))


@query("u06_renamed_collections", """select archive, case when collection like 'set-%' then 'group' || substr(collection, 4) else collection end as collection, ord,
  case when archive = 'EUROPE' and ref like 'collections/set-%' and replace(ref, 'collections/', '') in (select collection from @collection_entries where archive = 'EUROPE') then replace(ref, 'collections/set', 'collections/group') else ref end as ref, note from @collection_entries""")
def renamed_collections(cat):
    sets = cat.collection_entries.where("collection like 'set-%'").select(
        "archive", F.col("collection").alias("old_name")).distinct()
    changes = sets.withColumn("new_name", F.concat(F.lit("group"), F.expr("substring(old_name, 4)")))
    return ch.rename_collections(cat.collection_entries, changes)


# Links between brands of one archive: circles of two and of three, and chains that close none.
CIRCLES = """links as (select distinct cal_archive as archive, p_brand as collection, cast(substr(p_brand, 7) as integer) as n from part join @calibrations on p_partkey = cal_part),
adds as (select archive, collection, 'collections/Brand#' || cast(case when n <= 2 then 3 - n when n <= 5 then 3 + (n - 2) % 3 when n <= 9 then n + 1 when n = 11 then 11
    when n <= 14 and n >= 12 then 12 + (n - 11) % 3 when n = 15 then 12 end as string) as ref from links),
nested as (select archive, collection as parent, replace(ref, 'collections/', '') as child from adds where ref is not null and ref <> 'collections/' || collection
  union select archive, collection, replace(ref, 'collections/', '') from @collection_entries where ref like 'collections/%'),
reach as (select archive, parent as start, child as target from nested union select r.archive, r.start, n.child from reach r join nested n on r.archive = n.archive and r.target = n.parent),
judged as (select a.archive, a.collection, a.ref, case when 'collections/' || a.collection = a.ref then 'contains itself' when r.start is not null then 'makes a cycle' end as refused
  from adds a left join reach r on a.archive = r.archive and r.start = replace(a.ref, 'collections/', '') and r.target = a.collection where a.ref is not null)"""


def circles_of(cat):
    brands = cat.part.join(cat.calibrations, F.col("p_partkey") == F.col("cal_part")).select(
        F.col("cal_archive").alias("archive"), F.col("p_brand").alias("collection")).distinct()
    n = F.substring("collection", 7, 2).cast("int")
    to = (F.when(n <= 2, 3 - n).when(n <= 5, 3 + (n - 2) % 3).when(n <= 9, n + 1).when(n == 11, 11)
          .when((n >= 12) & (n <= 14), 12 + (n - 11) % 3).when(n == 15, 12))
    return brands.withColumn("ref", F.concat(F.lit("collections/Brand#"), to.cast("string"))).where("ref is not null")


@query("u06_refused_circles", f"with recursive {CIRCLES} select * from judged where refused is not null")
def refused_circles(cat):
    """Links that would close a circle, of two, three or more collections."""
    return ch.add_entries(cat.collection_entries, circles_of(cat))[1]


@query("u06_added_links", f"with recursive {CIRCLES} select archive, collection, ref from judged where refused is null")
def added_links(cat):
    return ch.add_entries(cat.collection_entries, circles_of(cat))[0]


MOVING = """moved as (select distinct e.archive, e.collection, e.ref, 'Brand#' || cast(cast(substr(e.collection, 7) as integer) % 25 + 1 as string) as target
  from @collection_entries e where e.collection like 'Brand#%' and e.ref not like 'prov:%' and e.ref not like 'collections/%' and e.ref not like '%|%' and e.ord % 3 = 0),
refused as (select m.*, 'already there' as refused from moved m semi join @collection_entries o on m.archive = o.archive and m.target = o.collection and m.ref = o.ref),
done as (select m.* from moved m anti join refused r on m.archive = r.archive and m.target = r.target and m.ref = r.ref),
last as (select archive, collection, max(ord) as top from @collection_entries group by 1, 2),
arriving as (select d.archive, d.target, d.ref, arg_min(e.note, d.collection) as note from done d join @collection_entries e on d.archive = e.archive and d.collection = e.collection and d.ref = e.ref group by 1, 2, 3),
after as (select e.archive, e.collection, e.ord, e.ref, e.note from @collection_entries e anti join done d on e.archive = d.archive and e.collection = d.collection and e.ref = d.ref
  union all select a.archive, a.target, coalesce(top, -1) + row_number() over (partition by a.archive, a.target order by a.ref), a.ref, a.note
  from arriving a left join last l on a.archive = l.archive and a.target = l.collection)"""


def moved_of(cat):
    entries = cat.collection_entries.where(
        "collection like 'Brand#%' and ref not like 'prov:%' and ref not like 'collections/%' and ref not like '%|%' and ord % 3 = 0")
    to = F.concat(F.lit("Brand#"), (F.substring("collection", 7, 2).cast("int") % 25 + 1).cast("string"))
    return ch.move_entries(cat.collection_entries, entries.select("archive", "collection", to.alias("target"), "ref").distinct())


@query("u06_moved_entries", f"with {MOVING} select archive, collection, cast(ord as bigint) as ord, ref, note from after")
def moved_entries(cat):
    """A third of the brands' entries moved one brand on, behind the entries there."""
    return moved_of(cat)[0].withColumn("ord", F.col("ord").cast("bigint"))


@query("u06_refused_moves", f"with {MOVING} select distinct archive, target as collection, ref, refused from refused")
def refused_moves(cat):
    return moved_of(cat)[1].distinct()


# -- people ----------------------------------------------------------------------------

@query("w09_current_identities", "select petname, arg_max(id, ord) as current, arg_min(display, ord) filter (where display is not null) as display, count(*) as n_ids from @trail group by 1")
def current_identities(cat):
    return pe.current_identities(cat.trail)


@query("a14_shared_identities", "select id, count(distinct petname) as n_contacts, min(petname) as first_contact from @trail group by 1 having count(distinct petname) > 1")
def shared_identities(cat):
    return pe.shared_identities(cat.trail)


@query("j12_consolidated_identities", """with users as (select o_orderkey as orderkey, case o_orderpriority when '1-URGENT' then 'pet-' || cast(o_custkey % 30 as string) || '-building@localid'
    else 'user' || cast(o_custkey as string) || '@example.org' end as user from orders),
now_ids as (select petname, arg_max(id, ord) as current, max(display) as display from @trail group by 1), whose as (select id, min(petname) as petname from @trail group by 1),
n as (select u.*, u.user like '%@localid' as is_alias, case when u.user like '%@localid' then replace(u.user, '@localid', '') else w.petname end as pet from users u left join whose w on u.user = w.id)
select orderkey, n.user, c.petname, case when is_alias and c.petname is null then null else coalesce(current, n.user) end as current,
  case when c.petname is not null then coalesce(display, c.petname) else n.user end as label, coalesce(current = n.user, false) as is_current,
  case when is_alias and c.petname is null then 'no such contact' end as error from n left join now_ids c on n.pet = c.petname""")
def consolidated_identities(cat):
    users = cat.orders.select(F.col("o_orderkey").alias("orderkey"), F.when(
        F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("pet-"), (F.col("o_custkey") % 30).cast("string"), F.lit("-building@localid")))
        .otherwise(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.org"))).alias("user"))
    return pe.consolidate(users, cat.trail)


@query("j12_same_person", """with p as (select 'user' || cast(c_custkey as string) || '@example.org' as a, 'user' || cast((c_custkey + 25) % 997 as string) || '@example.org' as b from customer),
w as (select id, min(petname) as pet from @trail group by 1)
select a, b, a = b or exists (select 1 from w join @trail t on t.petname = w.pet where w.id = p.a and t.id = p.b) as same from p""")
def same_person(cat):
    pairs = cat.customer.select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("a"),
        F.concat(F.lit("user"), ((F.col("c_custkey") + 25) % 997).cast("string"), F.lit("@example.org")).alias("b"))
    return pe.same_person(pairs, cat.trail)


# Suppliers as registered archives: several nicknames and places for one archive.
REGISTRY = """select 'nick-' || cast(s_suppkey as string) as nickname, 'lab-' || cast(s_nationkey as string) as name,
  case when s_acctbal < 0 then '' else 'owner' || cast(s_nationkey % 3 as string) end as owner, s_suppkey as ord, 'vol-' || cast(s_suppkey % 4 as string) as location from {supplier}"""
REG = "reg as (" + REGISTRY.replace("{supplier}", "supplier") + ")"


@query("j13_archive_lookup", f"""with {REG}, wanted as (select o_orderkey as orderkey, 'lab-' || cast(o_custkey % 27 as string) as name, case when o_orderstatus = 'O' then null when o_orderstatus = 'P' then 'me' else 'owner1' end as owner from orders),
any_owner as (select name, arg_min(nickname, ord) as nick from reg group by 1), by_owner as (select name, case owner when '' then 'me' else owner end as owner, arg_min(nickname, ord) as nick from reg group by 1, 2)
select orderkey, w.name, w.owner, case when w.owner is null then a.nick else b.nick end as nickname from wanted w left join any_owner a on w.name = a.name left join by_owner b on w.name = b.name and w.owner = b.owner""")
def archive_lookup(cat):
    registry = cat.spark.sql(REGISTRY, supplier=cat.supplier)
    wanted = cat.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.concat(F.lit("lab-"), (F.col("o_custkey") % 27).cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "P", "me").when(F.col("o_orderstatus") == "F", "owner1").alias("owner"))
    return pe.find_archives(wanted, registry, "me")


@query("u07_archive_locations", f"""with {REG}, n as (select owner, name, count(distinct nickname) as n_nicknames from reg group by 1, 2),
f as (select *, row_number() over (partition by owner, name, location order by nickname, ord) as r from reg)
select f.owner, f.name, location, nickname, ord, n_nicknames from f join n on f.owner = n.owner and f.name = n.name where r = 1""")
def archive_locations(cat):
    return pe.archive_locations(cat.spark.sql(REGISTRY, supplier=cat.supplier))
