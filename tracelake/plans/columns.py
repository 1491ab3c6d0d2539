"""Column normalization over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import identity, ids, policy, refs, text, times
from tracelake.operators.store import with_archive_settings
from tracelake.plans.registry import NOW, THIS_YEAR, TODAY, query

KEY = ["archive", "run_id", "filename"]

# The checking engine's own parse of a reference, shared by the P1-P5 checks.
PARSED = r"""
with t0 as (select archive, run_id, filename, ref, trim(ref) as t from @ref_texts),
t1 as (select *, lower(t) like 'prov://%' as uri, string_split(t, '|') as bars,
         string_split(substr(t, 8), '/') as seg from t0),
t2 as (select *, case when uri then 1 else len(bars) end as nbar,
         case when not uri and len(bars) = 2 then trim(bars[1]) end as arc,
         case when not uri and len(bars) = 2 then trim(bars[2]) else t end as body,
         list_filter(seg[3:], lambda x: x <> '') as rest from t1),
t3 as (select *, strpos(body, '/') as cut, trim(substr(body, 1, strpos(body, '/') - 1)) as head,
         trim(substr(body, strpos(body, '/') + 1)) as tail,
         coalesce(rest[1] in ('collections', 'assets'), false) as sib from t2),
t4 as (select *, case when t = '' then 'empty'
    when uri then case when len(seg) < 2 or trim(seg[1]) = '' or trim(seg[2]) = '' then 'bad_uri'
      when sib and len(rest) <> 2 then 'bad_sibling_uri'
      when not sib and len(rest) > 2 then 'too_many_segments' end
    when nbar > 2 then 'multiple_archive_separators'
    when nbar = 2 and arc = '' then 'empty_archive'
    when nbar = 2 and body = '' then 'nothing_after_archive'
    when cut > 0 and (head = '' or tail = '') then 'empty_segment'
    when cut > 0 and contains(tail, '/') then
      case when head in ('collections', 'assets') then 'separator_in_segment' else 'too_many_segments' end
  end as ref_error from t3),
parsed as (select archive, run_id, filename, ref, ref_error,
  case when ref_error is null and uri then trim(seg[1]) end as ref_user,
  case when ref_error is null then case when uri then trim(seg[2]) else arc end end as ref_archive,
  case when ref_error is null then case when uri then case when not sib then trim(rest[1]) end
    when cut > 0 then case when head not in ('collections', 'assets') then head end
    when regexp_matches(body, '^[SI]-\d{2}-\d+$') then body end end as ref_session,
  case when ref_error is null then case when uri then case when not sib then trim(rest[2]) end
    when cut > 0 then case when head not in ('collections', 'assets') then tail end
    when not regexp_matches(body, '^([SI]|AF)-\d{2}-\d+$') then body end end as ref_file,
  case when ref_error is null then case when uri then case when rest[1] = 'collections' then trim(rest[2]) end
    when cut > 0 and head = 'collections' then tail end end as ref_collection,
  case when ref_error is null then case when uri then case when rest[1] = 'assets' then trim(rest[2]) end
    when cut > 0 then case when head = 'assets' then tail end
    when regexp_matches(body, '^AF-\d{2}-\d+$') then body end end as ref_asset
  from t4),
spelled as (select *,
  case when ref_user is null or ref_archive is null then null else 'prov://' || ref_user || '/' || ref_archive ||
    case when ref_collection is not null then '/collections/' || ref_collection
      when ref_asset is not null then '/assets/' || ref_asset
      when ref_file is not null then '/' || ref_session || '/' || ref_file
      when ref_session is not null then '/' || ref_session else '' end end as uri_text,
  case when ref_collection is not null then 'collections/' || ref_collection
    when ref_asset is not null then 'assets/' || ref_asset
    when ref_file is not null and ref_session is not null then ref_session || '/' || ref_file
    else coalesce(ref_file, ref_session) end as body_text from parsed),
formatted as (select *, case when ref_user is not null then uri_text
    when body_text is null then ref_archive
    when ref_archive is not null then ref_archive || '|' || body_text else body_text end as short from spelled)
"""


def _parsed(cat):
    return refs.parse_refs(cat.ref_texts, "ref")


@query("p01_ref_parse", PARSED + """
select archive, run_id, filename, ref, ref_user, ref_archive, ref_session, ref_file, ref_collection,
  ref_asset, ref_error from parsed""")
def ref_parse(cat):
    """Every written reference split into its six parts or its mistake."""
    return _parsed(cat).drop("line")


@query("p02_ref_format", PARSED + """
select archive, run_id, filename, short,
  case when ref_session is null and ref_file is not null then null
    else 'prov://' || coalesce(ref_user, 'me@example.org') || '/' || coalesce(ref_archive, archive) ||
    case when ref_collection is not null then '/collections/' || ref_collection
      when ref_asset is not null then '/assets/' || ref_asset
      when ref_file is not null then '/' || ref_session || '/' || ref_file
      when ref_session is not null then '/' || ref_session else '' end end as full_uri
from formatted where ref_error is null""")
def ref_format(cat):
    """Shortest and fullest spelling of every well-formed reference."""
    return _parsed(cat).where("ref_error is null").select(
        *KEY, refs.format_ref().alias("short"),
        refs.format_uri(user=F.lit("me@example.org"), archive=F.col("archive")).alias("full_uri"))


@query("p03_ref_kind", PARSED + """
select case when ref_collection is not null then 'collection' when ref_asset is not null then 'asset'
    when ref_file is not null then 'file' when ref_session is not null then 'session' else 'archive' end as kind,
  ref_archive is not null as cross_archive, ref_user is not null as cross_user,
  ref_session is null and ref_collection is null and ref_asset is null as same_session, count(*) as n
from parsed where ref_error is null group by all""")
def ref_kinds(cat):
    """How many references there are of each kind and reach."""
    return (
        _parsed(cat).where("ref_error is null")
        .groupBy(refs.ref_kind().alias("kind"), refs.is_cross_archive().alias("cross_archive"),
                 refs.is_cross_user().alias("cross_user"), refs.is_same_session().alias("same_session"))
        .agg(F.count("*").alias("n")))


@query("p04_ref_resolution", PARSED + """
select archive, run_id, filename, coalesce(ref_user, 'me@example.org') as to_user,
  coalesce(ref_archive, archive) as to_archive,
  coalesce(ref_session, case when ref_collection is null and ref_asset is null then run_id end) as to_session,
  ref_file as to_file, ref_collection as to_collection, ref_asset as to_asset
from parsed where ref_error is null""")
def ref_resolution(cat):
    """References with the parts that mean "here" filled in."""
    parsed = _parsed(cat).where("ref_error is null")
    full = refs.resolve_in_context(parsed, F.col("archive"), F.col("run_id"), F.lit("me@example.org"))
    return full.select(*KEY, *[f"to_{p}" for p in refs.PARTS])


@query("p05_ref_canonical", PARSED + """
select short as canonical, count(*) as n, count(distinct ref) as spellings
from formatted where ref_error is null group by short""")
def ref_canonical(cat):
    """One row per target, however it was spelled."""
    spellings = refs.canonical_refs(cat.ref_texts.groupBy("ref").agg(F.count("*").alias("k")), "ref")
    return (spellings.groupBy("canonical")
            .agg(F.sum("k").alias("n"), F.count("*").alias("spellings"))
            .where("canonical is not null"))


@query("p06_run_id_decode", r"""
select archive, record_id,
  case when regexp_matches(record_id, '^[SI]-\d{2}-\d{4,}$') then substr(record_id, 1, 2) end as prefix,
  case when regexp_matches(record_id, '^[SI]-\d{2}-\d{4,}$') then cast(2000 + cast(substr(record_id, 3, 2) as integer) as integer) end as id_year,
  case when regexp_matches(record_id, '^[SI]-\d{2}-\d{4,}$') then cast(substr(record_id, 6) as bigint) end as number,
  regexp_matches(record_id, '^I-\d{2}-\d{4,}$') as provisional, run_id from @sessions""")
def run_id_decode(cat):
    rid = F.col("record_id")
    return cat.sessions.select(
        "archive", "run_id", "record_id", ids.id_prefix(rid).alias("prefix"),
        ids.id_year(rid).alias("id_year"), ids.id_number(rid).alias("number"),
        ids.is_provisional(rid).alias("provisional"))


TYPED = """select o_orderkey as orderkey, case o_orderpriority when '1-URGENT' then ' ' || cast(o_orderkey as string)
  when '2-HIGH' then '26-' || cast(o_custkey as string) when '3-MEDIUM' then 'i-25-' || cast(o_custkey as string)
  when '4-NOT SPECIFIED' then 's-24-' || lpad(cast(o_orderkey as string), 8, '0') else 'run ' || cast(o_orderkey as string)
  end as typed from {orders}"""


@query("p07_run_id_expand", f"""
with ty as ({TYPED.replace('{orders}', 'orders')}), u as (select *, upper(trim(typed)) as t from ty)
select orderkey, typed, case when regexp_matches(t, '^[SI]-\\d{{2}}-\\d{{4,}}$') then t
  when regexp_matches(t, '^([SI]-)?\\d{{2}}-\\d+$') then
    case when regexp_matches(t, '^[SI]-') then substr(t, 1, 2) else 'S-' end || regexp_extract(t, '(\\d{{2}})-\\d+$', 1) || '-' ||
    lpad(regexp_extract(t, '(\\d+)$', 1), greatest(4, length(regexp_extract(t, '(\\d+)$', 1)))::int, '0')
  when regexp_matches(t, '^\\d+$') then 'S-{THIS_YEAR % 100}-' || lpad(t, greatest(4, length(t))::int, '0') end as run_id
from u""")
def run_id_expand(cat):
    """Ids completed from what a person typed."""
    typed = cat.spark.sql(TYPED, orders=cat.orders)
    return typed.withColumn("run_id", ids.expand_run_id(F.col("typed"), THIS_YEAR))


@query("p08_asset_ids", r"""
select archive, run_id, filename, ref_asset, regexp_matches(ref_asset, '^AF-\d{2}-\d{4,}$') as is_asset,
  cast(substr(ref_asset, 4, 2) as integer) as year2, cast(substr(ref_asset, 7) as bigint) as number,
  cast(substr(ref_asset, 7) as bigint) // 100 as bucket,
  'AF-' || substr(ref_asset, 4, 2) || '-' || substr(ref_asset, 7) as formatted
from @edges where ref_asset is not null""")
def asset_ids(cat):
    a = F.col("ref_asset")
    return cat.edges.where(a.isNotNull()).select(
        *KEY, "ref_asset", ids.is_asset_id(a).alias("is_asset"), ids.asset_year(a).alias("year2"),
        ids.asset_number(a).alias("number"), ids.asset_bucket(a).alias("bucket"),
        ids.format_asset_id(ids.asset_year(a), ids.asset_number(a)).alias("formatted"))


WS = text.WHITESPACE


@query("p09_tag_normalization", f"""
with s as (select doc_id, list_filter(string_split(text, ','), lambda p: not regexp_matches(p, '^{WS}*$')) as parts from documents),
c as (select doc_id, parts, list_transform(parts, lambda p: case when not regexp_matches(p, '[,\\n\\r\\t]')
    then regexp_replace(regexp_replace(p, '{WS}+', ' ', 'g'), '^ | $', '', 'g') end) as got from s)
select doc_id, len(list_filter(got, lambda g: g is null))::integer as n_bad,
  len(list_distinct(list_filter(got, lambda g: g is not null)))::integer as n_tags,
  coalesce(got[list_position(list_transform(got, lambda g: g is not null), true)], '') as first_tag,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(got, lambda g: g is not null))), '|'), '') as tags
from c""")
def tag_normalization(cat):
    """Every document text read as a comma-separated tag field."""
    parts = F.filter(F.split("text", ","), lambda t: ~t.rlike(f"^{WS}*$"))
    got = cat.documents.select("doc_id", text.clean_tags(parts).alias("g"), text.bad_tags(parts).alias("b"))
    return got.select("doc_id", F.size("b").alias("n_bad"), F.size("g").alias("n_tags"),
                      F.coalesce(F.get("g", F.lit(0)), F.lit("")).alias("first_tag"),
                      F.array_join(F.array_sort("g"), "|").alias("tags"))


# Identity pieces as the checking engine sees them.
IDENT = r"""
with i0 as (select custkey, nationkey, identity, trim(identity) as raw from @identities),
i1 as (select *, contains(raw, '@') as explicit,
  case when contains(raw, '@') then regexp_extract(raw, '^(.*)@[^@]*$', 1) else raw end as value,
  case when contains(raw, '@') then lower(regexp_extract(raw, '@([^@]*)$', 1)) else 'local' end as authority from i0),
i2 as (select *, list_reduce(list_prepend(cast(0 as bigint), list_transform(
    string_split(rpad(substr(regexp_replace(value, '[^0-9]', '', 'g'), 1, 15), 15, '0'), ''), lambda c: cast(c as bigint))),
    lambda a, d: (a + d) * 2) as total from i1),
i3 as (select *, case when (12 - total % 11) % 11 = 10 then 'X' else cast((12 - total % 11) % 11 as string) end as check_digit from i2),
i4 as (select *, case when raw = '' then 'empty' when regexp_matches(raw, '[\s/|]') then 'illegal_character'
    when authority = 'localid' then 'alias_reserved' when value = '' then 'no_value'
    when explicit and authority = '' then 'no_authority' when authority = 'key' then 'key_reserved'
    when authority = 'github.com' then case when not regexp_matches(value, '^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$') or length(value) > 39 then 'bad_github' end
    when authority = 'orcid.org' then case when not regexp_matches(value, '^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$') then 'bad_orcid_shape'
      when right(value, 1) <> check_digit then 'bad_orcid_check_digit' end end as error from i3),
i5 as (select *, case when error is null then case when authority = 'local' then 'local_only'
    when authority not in ('orcid.org', 'github.com', 'key', 'localid') and not regexp_matches(authority,
      '^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,}$')
    then 'not_a_domain' end end as warning from i4)
"""


@query("p10_identity_split", IDENT + """
select custkey, identity, value, authority, explicit, value || '@' || authority as qualified from i1""")
def identity_split(cat):
    name = F.col("identity")
    return cat.identities.select(
        "custkey", "identity", identity.value_of(name).alias("value"),
        identity.authority_of(name).alias("authority"), identity.explicit(name).alias("explicit"),
        identity.qualified(name).alias("qualified"))


@query("p11_identity_validation", IDENT + "select custkey, identity, error, warning from i5")
def identity_validation(cat):
    """Mistakes and doubts about every identity."""
    name = F.col("identity")
    return cat.identities.select("custkey", "identity", identity.identity_error(name).alias("error"),
                                 identity.identity_warning(name).alias("warning"))


@query("p12_owner_presentation", IDENT + r"""
select custkey, raw as owner, nationkey > 3 as declared,
  nationkey > 3 and raw <> '' and raw <> 'User-2@Lab.Example.ORG' as claimed,
  raw || case when nationkey > 3 and raw <> '' and raw <> 'User-2@Lab.Example.ORG' then ' (claimed)' else '' end as display,
  case authority when 'local' then 'local name, not unique' when 'orcid.org' then 'ORCID' when 'github.com' then 'GitHub'
    when 'key' then 'signed key (not yet issued)' when 'localid' then 'local petname' else authority end as label,
  case when contains(raw, '/') then regexp_extract(raw, '([^/]*)/*$', 1) || '@' || regexp_extract(raw, '^(?:.*//)?([^/]*)', 1) end as paste_hint
from i5""")
def owner_presentation(cat):
    """How each owner is shown, and whether it is only a claim."""
    name, me, declared = text.strip(F.col("identity")), F.lit("User-2@Lab.Example.ORG"), F.col("nationkey") > 3
    return cat.identities.select(
        "custkey", name.alias("owner"), declared.alias("declared"),
        identity.owner_claimed(name, me, declared).alias("claimed"),
        identity.owner_display(name, me, declared).alias("display"),
        identity.authority_label(name).alias("label"), identity.paste_hint(name).alias("paste_hint"))


DURATION = """select o_orderkey as orderkey, cast(o_custkey as string) || case o_orderpriority when '1-URGENT' then 'h'
  when '2-HIGH' then '.5d' when '3-MEDIUM' then 'm' when '4-NOT SPECIFIED' then '' else ' weeks' end as typed from {orders}"""


@query("p13_hold_state", f"""
select archive, run_id, hold_until, coalesce(hold_until = 'forever' or
  (hold_until <> 'forever' and try_cast(hold_until as timestamptz) > timestamptz '{NOW}'), false) as held,
  coalesce(hold_until <> 'forever' and try_cast(hold_until as timestamptz) is null, false) as garbled from @sessions""")
def hold_state(cat):
    hold, now = F.col("hold_until"), F.lit(NOW).cast("timestamp")
    return cat.sessions.select("archive", "run_id", "hold_until", times.hold_active(hold, now).alias("held"),
                               times.hold_garbled(hold).alias("garbled"))


@query("p13_duration_parse", f"""
with d as ({DURATION.replace('{orders}', 'orders')})
select orderkey, typed, case when regexp_matches(typed, '^[0-9.]+[hmd]?$') then cast(regexp_extract(typed, '^[0-9.]+') as double) *
  case right(typed, 1) when 'h' then 3600.0 when 'd' then 86400.0 when 'm' then 60.0 else 1.0 end end as seconds from d""")
def duration_parse(cat):
    return cat.spark.sql(DURATION, orders=cat.orders).withColumn(
        "seconds", times.duration_seconds(F.col("typed")))


@query("p14_day_bucket", f"""
with d as (select archive, run_id, created, cast(timezone('UTC', cast(created as timestamptz)) as date) as day from @sessions)
select archive, run_id, created, case date '{TODAY}' - day when 0 then 'Today' when 1 then 'Yesterday'
  else case when date '{TODAY}' - day < 7 then strftime(day, '%A') else strftime(day, '%B %Y') end end as bucket from d""")
def day_bucket(cat):
    return cat.sessions.select("archive", "run_id", "created", times.day_bucket(
        F.col("created"), F.lit(TODAY).cast("date")).alias("bucket"))


@query("p15_timestamp_parse", """
select archive, run_id, created, cast(epoch(cast(created as timestamptz)) as bigint) as epoch_seconds,
  cast(null as bigint) as from_text from @sessions""")
def timestamp_parse(cat):
    """Instants of every session; free text gives null, not an error."""
    return cat.sessions.select(
        "archive", "run_id", "created", F.unix_timestamp(times.instant(F.col("created"))).alias("epoch_seconds"),
        F.unix_timestamp(times.instant(F.col("description"))).alias("from_text"))


@query("p16_human_size", """
with s as (select archive, asset_id as name, size from @assets union all select archive, run_id || '/' || name, size from @files)
select archive, name, size, case when size < 1024 then printf('%.0f B', size::double)
  when size < 1048576 then printf('%.1f KB', size / 1024.0::double) when size < 1073741824 then printf('%.1f MB', size / 1048576.0::double)
  when size < 1099511627776 then printf('%.1f GB', size / 1073741824.0::double) else printf('%.1f TB', size / 1099511627776.0::double) end as human
from s""")
def human_size(cat):
    named = cat.assets.select("archive", F.col("asset_id").alias("name"), "size").unionByName(
        cat.files.select("archive", F.concat_ws("/", "run_id", "name").alias("name"), "size"))
    return named.withColumn("human", text.human_size(F.col("size")))


@query("p17_name_rules", r"""
select page_id, url, left(regexp_replace(regexp_replace(trim(translate(url, '/\|:*?"<>', '---------')), '\.+$', ''), '\s{2,}', ' ', 'g'), 120) as slug,
  case when regexp_matches(url, '[/\\|:*?"<>]') then 'illegal_character' end as collection_problem,
  regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]*$') as search_ok,
  case when contains(url, '/') then 'not_a_plain_name' end as artifact_problem from pages""")
def name_rules(cat):
    """Page addresses judged as collection, search and artifact names."""
    url = F.col("url")
    return cat.pages.select(
        "page_id", "url", text.slugify(url).alias("slug"),
        text.collection_name_problem(url).alias("collection_problem"),
        text.search_name_ok(url).alias("search_ok"),
        text.rename_problem(F.lit("old.csv"), url).alias("artifact_problem"))


@query("p18_duplicate_name", """
select archive, run_id, display_name, duplicate_index, filename as name from @artifacts where duplicate_index is not null""")
def duplicate_name(cat):
    return cat.artifacts.where("duplicate_index is not null").select(
        "archive", "run_id", "display_name", "duplicate_index",
        ids.duplicate_name(F.col("display_name"), F.col("duplicate_index")).alias("name"))


@query("p19_content_hash", "select doc_id, sha256(text) as sha256 from documents")
def content_hash(cat):
    return cat.documents.select("doc_id", text.content_hash(F.col("text").cast("binary")).alias("sha256"))


@query("p20_manifest_id", """
select doc_id, sha256('{"entry":"' || source || '/main.py","files":{"' || source || '/doc-' || cast(doc_id as string) || '.txt":"' || sha256(text)
  || '","' || source || '/lang":"' || sha256(lang) || '"}}') as manifest from documents""")
def manifest_id(cat):
    """Id of a two-file manifest per document; equal content, equal id."""
    doc = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = F.array(
        F.struct(F.concat("source", F.lit("/lang")).alias("path"), F.sha2("lang", 256).alias("blob")),
        F.struct(doc.alias("path"), F.sha2("text", 256).alias("blob")))
    return cat.documents.select("doc_id", text.manifest_id(
        F.concat("source", F.lit("/main.py")), files).alias("manifest"))


@query("p20_manifest_rows", """
select m.manifest, sha256('{"entry":"' || any_value(entry) || '","files":{' || string_agg('"' || path || '":' || coalesce('"' || blob || '"', 'null'), ',' order by path) || '}}') as id
from @manifests m join @manifest_files f on m.manifest = f.manifest group by m.manifest""")
def manifest_rows(cat):
    """Ids of whole manifests, however many files they list."""
    return text.manifest_rows(cat.manifest_files.join(cat.manifests.select("manifest", "entry"), "manifest"))


@query("p21_source_facet", """
select archive, run_id, filename, coalesce(source, 'unrecorded') as facet from @sidecars where not trashed""")
def source_facet(cat):
    return cat.sidecars.where("not trashed").select(
        *KEY, text.source_facet(F.col("source"), F.col("source").isNotNull()).alias("facet"))


@query("p23_snapshot_policy", """
select a.archive, a.asset_id, case when coalesce(a.policy, '') in ('', 'auto') then
    case when size >= manual_above then 'manual' when size >= periodic_above then 'periodic' else asset_policy end
  when a.policy in ('every_change', 'on_reference', 'periodic', 'manual') then a.policy else 'on_reference' end as resolved,
  coalesce(a.period_days, r.period_days) as days, manual_above as auto_max,
  case when size >= manual_above then 'over the manual threshold' when size >= periodic_above then 'over the periodic threshold'
    when asset_policy = 'manual' then 'over the manual threshold' else 'below the size thresholds' end as reason
from @assets a join @archives r on a.archive = r.archive""")
def snapshot_policy(cat):
    """Policy in force for every asset, from its size and its archive."""
    got = with_archive_settings(cat.assets, cat.archives)
    ladder = policy.policy_for_size(F.col("size"), F.col("asset_policy"), F.col("periodic_above"),
                                    F.col("manual_above"))
    return got.select("archive", "asset_id", "resolved", "days", "auto_max",
                      policy.policy_reason(ladder).alias("reason"))


UNSAFE = """select doc_id, case lang when 'es' then '../' || source when 'fr' then '/abs/' || source
  when 'de' then 'C:\\\\x\\\\' || source else source || '/a..b/doc' end as path from {documents}"""


@query("p24_unsafe_path", "with u as (" + UNSAFE.replace("{documents}", "documents").replace("\\\\", "\\") + """)
select doc_id, path, path like '/%' or path like '../%' or path like 'C:%' as unsafe from u""")
def unsafe_path(cat):
    return cat.spark.sql(UNSAFE, documents=cat.documents).withColumn(
        "unsafe", text.unsafe_path(F.col("path")))


REMOTE = """case right(repo, 1) when '0' then 'git@github.com:lab/' || repo || '.git' when '1' then 'https://git.example.org/' || repo
  when '2' then 'https://git.example.org/' || repo || '.git' when '3' then '/srv/' || repo end"""


@query("p25_source_link", f"""
with r as (select archive, run_id, filename, repo, commit, dirty, entry_point, {REMOTE} as remote from @sidecars where repo is not null)
select archive, run_id, filename,
  case when remote like 'git@%' then 'https://github.com/lab/' || repo when remote like 'https%' then 'https://git.example.org/' || repo end
    || '/blob/' || commit || '/' || entry_point as link,
  coalesce(remote like 'git@%' or remote like 'https%', false) and dirty as dirty_warning from r""")
def source_link(cat):
    """Address of the exact script version behind every artifact."""
    remote = F.expr(REMOTE)
    return cat.sidecars.where("repo is not null").select(
        *KEY, text.source_link(remote, F.col("commit"), F.col("entry_point")).alias("link"),
        (text.web_remote(remote).isNotNull() & F.col("dirty")).alias("dirty_warning"))


@query("p26_activity_shade", """
with d as (select archive, substr(created, 1, 10) as day, count(*) as n from @sessions group by 1, 2),
b as (select archive, max(n) as busiest from d group by 1)
select d.archive, day, n, case when busiest <= 1 then 3 when n / busiest > 0.66 then 3 when n / busiest > 0.33 then 2 else 1 end as shade
from d join b on d.archive = b.archive""")
def activity_shade(cat):
    days = cat.sessions.groupBy("archive", F.substring("created", 1, 10).alias("day")).agg(
        F.count("*").alias("n"))
    busiest = days.groupBy("archive").agg(F.max("n").alias("busiest"))
    return days.join(busiest, "archive").select(
        "archive", "day", "n", text.activity_shade(F.col("n"), F.col("busiest")).alias("shade"))


@query("p27_labels", """
select archive, run_id, filename, case when source = 'external' then 'external: ' || coalesce(origin, '(no origin recorded)')
  else coalesce(repo, '-') || '@' || coalesce(substr(commit, 1, 8), '-') || case when dirty then ' (dirty)' else '' end end as provenance
from @sidecars where not trashed""")
def labels(cat):
    return cat.sidecars.where("not trashed").select(*KEY, text.provenance_label(
        F.col("source"), F.col("origin"), F.col("repo"), F.col("commit"), F.col("dirty")).alias("provenance"))


@query("p27_ref_labels", """
select archive, run_id, filename, ord, coalesce(ref_archive, '(local)') || '|' || coalesce(ref_session, '(same session)') || '/' ||
  coalesce(ref_file, '(whole session)') as label from @edges""")
def ref_labels(cat):
    return cat.edges.select(*KEY, "ord", text.ref_label(
        F.col("ref_archive"), F.col("ref_session"), F.col("ref_file")).alias("label"))
