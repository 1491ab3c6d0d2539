"""Reading and writing documents rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.registry import query
from tracelake.plans.transfer import CLOSURE, entries_of, exported_of, wanted_of
from tracelake.operators import transfer as tr
from tracelake.session import staging_root
from tracelake.sources import documents as dc
from tracelake.sources import sinks

NO = "cast(null as string)"


@query("s01_file_inventory", """select archive, year, run_id, name, case when name like '%.meta.json' then 'sidecar' else 'data' end as role, size from (
  select archive, year, run_id, name, size from @files union all select archive, year, run_id, filename || '.meta.json', cast(200 as bigint) from @sidecars where not trashed) f""")
def file_inventory(cat):
    """Paths of a whole file tree taken apart, odd folders left out."""
    root = F.concat_ws("/", F.lit("file:/lake"), "archive", F.lit("data"), F.col("year").cast("string"), "run_id")
    paths = cat.files.select("archive", F.concat_ws("/", root, "name").alias("path"), F.col("size").alias("length")).unionByName(
        cat.sidecars.select("archive", F.concat(root, F.when(F.col("trashed"), "/.trash/").otherwise("/"), "filename", F.lit(".meta.json")).alias("path"),
                            F.lit(200).cast("bigint").alias("length"))).unionByName(
        cat.sessions.select("archive", F.concat_ws("/", F.lit("file:/lake"), "archive", F.lit("data/misc"), "run_id", F.lit("x.csv")).alias("path"),
                            F.lit(1).cast("bigint").alias("length")))
    listed = dc.file_inventory(paths.withColumn("modificationTime", F.lit(None).cast("timestamp")), F.col("archive"))
    return listed.where("not trashed").select("archive", "year", "run_id", "name", "role", "size")


def sidecar_documents(cat):
    made = F.struct("repo", "commit", "dirty", "entry_point", "code", "source", "origin")
    return cat.sidecars.select("archive", "run_id", "filename", "trashed", F.when(F.col("readable"), F.to_json(F.struct(
        "created", made.alias("produced_by"), "sha256", "original_name", "duplicate_index",
        F.array(F.struct(F.col("filename").alias("file"))).alias("derived_from"), F.lit("v2").alias("layout")))).otherwise(
        F.lit('{"created": "2024')).alias("content"))


@query("s02_sidecar_documents", """select archive, run_id, filename, created, coalesce(source, 'script') as source, source is not null as source_recorded, origin, repo, dirty, code, sha256, original_name,
  duplicate_index, 'v2' as layout from @sidecars where readable""")
def sidecars(cat):
    """Sidecar JSON read back: typed columns, defaults, unknown keys kept."""
    good, _bad = dc.parse_sidecars(sidecar_documents(cat))
    return good.select("archive", "run_id", "filename", "created", "source", "source_recorded", "origin", "repo", "dirty", "code",
                       "sha256", "original_name", "duplicate_index", F.element_at("extra", "layout").alias("layout"))


@query("s02_sidecar_rejects", "select archive, run_id, filename, 'not JSON' as error from @sidecars where not readable")
def sidecar_rejects(cat):
    return dc.parse_sidecars(sidecar_documents(cat))[1].drop("trashed")


@query("s11_trashed_sidecars", "select archive, run_id, filename, trashed from @sidecars where readable")
def trashed_sidecars(cat):
    """Sidecars of the trash read together with the others."""
    return dc.parse_sidecars(sidecar_documents(cat))[0].select("archive", "run_id", "filename", "trashed")


def session_documents(cat):
    lines = [F.concat(F.lit("run_id: "), "run_id"), F.concat(F.lit("created: '"), "created", F.lit("'")),
             F.concat(F.lit("status: "), "status"), F.concat(F.lit("tags: ['"), "tag_a", F.lit("', '"), "tag_b", F.lit("']")),
             F.concat(F.lit("description: '"), "description", F.lit("'"))]
    text = F.when(F.col("record_state") == "ok", F.concat_ws("\n", *lines)).otherwise("run_id: [unclosed")
    return cat.session_rows.where("record_state <> 'missing'").select("archive", F.col("run_id").alias("folder"), text.alias("content"))


@query("s03_session_documents", "select archive, run_id as folder, run_id as record_id, created, status, tag_a || '|' || tag_b as tags, description from @session_rows where record_state = 'ok'")
def sessions(cat):
    good, _bad = dc.parse_sessions(session_documents(cat))
    return good.select("archive", "folder", "record_id", "created", "status", F.array_join("tags", "|").alias("tags"), "description")


@query("s03_session_rejects", "select archive, run_id as folder from @session_rows where record_state = 'unreadable'")
def session_rejects(cat):
    return dc.parse_sessions(session_documents(cat))[1].select("archive", "folder")


@query("s04_annotation_documents", """select 'EUROPE' as archive, cast(l.doc_id as string) as run_id, cast(null as string) as filename, 'quality ' || quality as tags, '' as comment from labels l
union all select 'EUROPE', cast(l.doc_id as string), 'doc.txt', 'toxic ' || toxic, lang || ' ' || source from labels l join documents d on l.doc_id = d.doc_id""")
def annotations(cat):
    """Notes on labelled documents; the bad tag among them is passed over."""
    text = F.concat(F.lit("version: 1\nsession:\n  tags: ['  quality   "), F.col("quality").cast("string"), F.lit(" ', 'a,b']\nartifacts:\n  doc.txt:\n    tags: [toxic "),
                    F.col("toxic").cast("string"), F.lit("]\n    comment: ' "), "lang", F.lit(" "), "source", F.lit(" '\n  junk.txt: 7\n"))
    docs = cat.labels.join(cat.documents, "doc_id").select(F.lit("EUROPE").alias("archive"), F.col("doc_id").cast("string").alias("run_id"), text.alias("content"))
    return dc.parse_annotations(docs).withColumn("tags", F.array_join("tags", "|"))


@query("s05_collection_documents", """select 'EUROPE' as archive, 'part-' || cast(p_partkey as string) as collection, 0 as ord, 'S-24-' || lpad(cast(p_partkey as string), 8, '0') as ref, '' as note, 'session' as points_at from part
union all select 'EUROPE', 'part-' || cast(p_partkey as string), 1, 'collections/' || p_brand, p_name, 'collection' from part""")
def collections(cat):
    text = F.concat(F.lit("title: t\nentries:\n- S-24-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("\n- {ref: 'collections/"),
                    "p_brand", F.lit("', note: '"), "p_name", F.lit("'}\n"))
    docs = cat.part.select(F.lit("EUROPE").alias("archive"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("collection"), text.alias("content"))
    from tracelake.functions.refs import ref_kind
    return dc.parse_collections(docs).select("archive", "collection", "ord", "ref", "note", ref_kind().alias("points_at"))


@query("s06_search_documents", "select 'EUROPE' as archive, 'by-' || cast(s_suppkey as string) as name, 'origin:lab-' || cast(s_suppkey as string) as query, 'filename|tags' as fields, '1998-01-01' as date_from from supplier")
def searches(cat):
    text = F.concat(F.lit("query: 'origin:lab-"), F.col("s_suppkey").cast("string"), F.lit("'\nfields: [filename, tags]\ndate_from: 1998-01-01\n"))
    docs = cat.supplier.select(F.lit("EUROPE").alias("archive"), F.concat(F.lit("by-"), F.col("s_suppkey").cast("string")).alias("name"), text.alias("content"))
    return dc.parse_searches(docs).select("archive", "name", "query", F.array_join("fields", "|").alias("fields"), "date_from")


@query("s07_asset_documents", "select archive, asset_id, 1 as ord, sha256, size as bytes, false as pending_gc, policy from @assets where record_state = 'ok'")
def assets(cat):
    """Asset records with their versions as rows."""
    record = F.to_json(F.struct(F.col("asset_id").alias("id"), "created", "name", "policy", "size", "sha256", F.array(F.struct(
        "sha256", F.col("created").alias("at"), F.col("size").alias("bytes"))).alias("snapshots")))
    docs = cat.assets.where("record_state <> 'missing'").select("archive", F.when(F.col("record_state") == "ok", record).otherwise("{").alias("content"))
    good, _bad = dc.parse_assets(docs)
    return dc.asset_snapshots(good).select("archive", "asset_id", "ord", "sha256", "bytes", "pending_gc").join(
        good.select("archive", F.col("id").alias("asset_id"), "policy"), ["archive", "asset_id"])


@query("s08_manifest_documents", """select sha256(cast(doc_id as string)) as manifest, source || '/main.py' as entry, source || '/doc-' || cast(doc_id as string) || '.txt' as path, sha256(text) as blob from documents
union all select sha256(cast(doc_id as string)), source || '/main.py', source || '/lang', sha256(lang) from documents""")
def manifests(cat):
    doc = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    record = F.to_json(F.struct(F.concat("source", F.lit("/main.py")).alias("entry"), F.create_map(
        doc, F.sha2("text", 256), F.concat("source", F.lit("/lang")), F.sha2("lang", 256)).alias("files")))
    return dc.parse_manifests(cat.documents.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("manifest"), record.alias("content")))


@query("s09_archive_settings", """select 'lake/arc-' || cast(c_custkey as string) as folder, case c_mktsegment when 'BUILDING' then 'arc-' || cast(c_custkey as string) else 'Archive ' || cast(c_custkey as string) end as archive,
  case c_mktsegment when 'BUILDING' then 'me' else 'owner' || cast(c_nationkey as string) end as owner, c_mktsegment <> 'BUILDING' as owner_declared,
  case c_mktsegment when 'BUILDING' then 'standard' when 'FURNITURE' then 'intake' else 'fragment' end as kind,
  case c_mktsegment when 'FURNITURE' then 'cancel' else 'duplicate' end as on_overwrite, case c_mktsegment when 'MACHINERY' then 'periodic' else 'on_reference' end as asset_policy, 'mark' as cap_action,
  cast(268435456 as bigint) as periodic_above, cast(8589934592 as bigint) as manual_above, c_nationkey + 1 as period_days from customer""")
def archive_settings(cat):
    """Settings with typos and gaps, one archive per customer."""
    key = F.col("c_custkey").cast("string")
    named = F.concat(F.lit("name: 'Archive "), key, F.lit("'\nuser: owner"), F.col("c_nationkey").cast("string"), F.lit("\nkind: "),
                     F.when(F.col("c_mktsegment") == "FURNITURE", "intake\non_overwrite: cancel").otherwise("fragment\non_overwrite: ask"),
                     F.lit("\nasset_policy: "), F.when(F.col("c_mktsegment") == "MACHINERY", "periodic").otherwise("auto"), F.lit("\nasset_cap_action: burn\n"))
    text = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(named), F.lit("asset_period_days: "), (F.col("c_nationkey") + 1).cast("string"))
    docs = cat.customer.select(F.concat(F.lit("lake/arc-"), key).alias("folder"), text.alias("content"))
    return dc.parse_settings(docs, "me").drop("max_snapshots", "max_snapshot_bytes")


@query("s10_seal_documents", "select n_name as archive, r_regionkey + 2000 as year, sha256(n_name) as digest, cast(c as bigint) as sessions from (select n_name, r_regionkey, count(*) as c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2) t")
def seals(cat):
    """Seals written per nation, with the number of its customers."""
    counted = cat.customer.join(cat.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey").agg(F.count("*").alias("c"))
    text = F.concat(F.lit("version: 1\ndigest: "), F.sha2("n_name", 256), F.lit("\nsessions: "), F.col("c").cast("string"), F.lit("\nsealed: 2024-01-01\n"))
    return dc.parse_seals(counted.select(F.col("n_name").alias("archive"), (F.col("n_regionkey") + 2000).alias("year"), text.alias("content"))).drop("sealed")


@query("s13_fragment", f"""with recursive {CLOSURE}, taken as (select w.* from want w semi join @sessions s on w.archive = s.archive and w.run_id = s.run_id where size is not null)
select 'files' as name, count(*) as n from @files f semi join taken t on f.archive = t.archive and f.run_id = t.run_id and f.name = t.name
union all select 'sidecars', count(*) from @sidecars c semi join taken t on c.archive = t.archive and c.run_id = t.run_id and c.filename = t.name
union all select 'edges', count(*) from @edges c semi join taken t on c.archive = t.archive and c.run_id = t.run_id and c.filename = t.name
union all select 'sessions', count(*) from plan union all select 'related_runs', count(*) from @related_runs r semi join plan p on r.archive = p.archive and r.run_id = p.run_id""")
def fragment(cat):
    """A fragment written to the shared folder and read back, rows per table."""
    import uuid

    closed, sessions, files = exported_of(cat)
    plan, _ = tr.plan_export(closed, sessions, files)
    want = wanted_of(closed, sessions, files)
    tables = {n: getattr(cat, n) for n in ("sessions", "related_runs", "files", "sidecars", "edges", "manifest_files", "archives")}
    chosen = sinks.fragment_tables(tables, plan, want, tr.manifests_for(want, cat.sidecars), tr.export_collections(entries_of(cat), plan, want))
    path = f"{staging_root(cat.spark)}/tracelake-fragment-{uuid.uuid4().hex}"
    sinks.write_catalog(chosen, path)
    out = None
    for name in ("sessions", "related_runs", "files", "sidecars", "edges"):
        one = cat.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
