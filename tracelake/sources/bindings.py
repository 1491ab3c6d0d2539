"""The catalog tables, projected from the driver's parquet tables.

Every table is one SQL projection. ``{name}`` marks a table, either a driver
table or another projection, and ``{sha}(..)`` the SHA-256 function, which is
all that differs between engines. The two tables that need ranking are ranked
by this package's own naming and ranking operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.skew import attach, rank_by_key, rank_in_groups
from tracelake.session import stage, tune

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def digits(expr: str, width: int) -> str:
    text = f"cast({expr} as string)"
    return f"lpad({text}, cast(greatest({width}, length({text})) as int), '0')"


def day(expr: str) -> str:
    return f"cast(cast({expr} as date) as string)"


YY = "lpad(cast(cast(year(o_orderdate) as int) % 100 as string), 2, '0')"

TABLES: dict[str, str] = {}

TABLES["archives"] = """
select r_name as archive,
  case r_regionkey when 0 then '' when 1 then 'america'
       else lower(replace(r_name, ' ', '-')) || '@example.org' end as owner,
  case r_regionkey when 2 then 'intake' when 4 then 'fragment' else 'standard' end as kind,
  lower(r_name) as nickname,
  r_regionkey <> 4 as reachable,
  case when r_regionkey = 1 then '2024-01-01T00:00:00+00:00' else '' end as merged_at,
  case r_regionkey when 0 then 'on_reference' when 1 then 'every_change' else 'manual' end as asset_policy,
  cast(268435456 as bigint) as periodic_above,
  cast(8589934592 as bigint) as manual_above,
  7 + r_regionkey as period_days,
  case r_regionkey when 0 then 0 else 40 + r_regionkey end as max_snapshots,
  cast(case r_regionkey when 1 then 0 else 1000 end as bigint) as max_snapshot_bytes
from {region}
"""

TABLES["session_rows"] = f"""
select o_orderkey as orderkey, o_custkey as custkey, r_name as archive,
  case when r_name = 'ASIA' then 'I-' else 'S-' end || {YY} || '-' || {digits('o_orderkey', 8)} as run_id,
  cast(year(o_orderdate) as int) as year,
  {day('o_orderdate')} || 'T' || lpad(cast(o_custkey % 24 as string), 2, '0') || ':30:00'
    || case when c_mktsegment = 'BUILDING' then '+05:00' else '+00:00' end as created,
  case when c_acctbal < -900 then 'paused' when o_orderstatus = 'F' then 'closed'
       when o_orderstatus = 'O' then 'open' else 'crashed' end as status,
  o_orderpriority as tag_a, c_mktsegment as tag_b,
  o_orderpriority || ' ' || c_name as description,
  case when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then 'forever'
       when o_orderpriority = '4-NOT SPECIFIED' then {day('o_orderdate')} || 'T23:59:59+00:00'
       when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then 'next week'
  end as hold_until,
  case when c_acctbal between -800 and -750 then 'missing'
       when c_acctbal between -750 and -700 then 'unreadable' else 'ok' end as record_state,
  c_acctbal > 9900 as renumbered,
  c_acctbal between 9000 and 9100 as twice,
  case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'EUROPE|' || {YY}
  end as merged_note,
  case when o_orderpriority = '2-HIGH' and r_name = 'EUROPE'
       then 'adopted from prov://middle-east@example.org/MIDDLE EAST/S-' || {YY} || '-' || {digits('o_orderkey + 1', 8)}
  end as adopted_note,
  'S-' || {YY} || '-' || {digits('o_orderkey - 1', 8)} as related_session,
  case when o_orderpriority = '2-HIGH' then 'MIDDLE EAST' when o_orderpriority = '1-URGENT' then 'EUROPE'
  end as related_archive
from {{orders}} join {{customer}} on o_custkey = c_custkey
  join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
"""

TABLES["folders"] = """
select archive, run_id, year, 'data/' || cast(year as string) || '/' || run_id as path, record_state
from {session_rows}
union all
select archive, run_id, year, 'data/' || cast(year + 1 as string) || '/' || run_id as path, record_state
from {session_rows} where twice
"""

TABLES["sessions"] = """
select archive, run_id, year, created, status, tag_a, tag_b, description, hold_until,
  case when renumbered then 'S-00-0000' else run_id end as record_id,
  'data/' || cast(year as string) || '/' || run_id as rel_path, merged_note, adopted_note
from {session_rows} where record_state = 'ok'
"""

# What listing the folders and reading their records gives, with no verdict in it.
TABLES["session_records"] = "select archive, run_id, path from {folders} where record_state = 'ok'"
TABLES["session_rejects"] = "select archive, run_id, path from {folders} where record_state = 'unreadable'"

TABLES["related_runs"] = """
select archive, run_id, related_archive as ref_archive, related_session as ref_session,
  cast(null as string) as ref_file, cast(null as string) as ref_user
from {session_rows} where record_state = 'ok'
"""

# One write request per line item; the naming operator decides the file names.
TABLES["requests"] = f"""
select archive, run_id, year, orderkey, custkey, l_partkey as partkey, l_suppkey as suppkey,
  l_linenumber as line,
  'line-' || cast(l_linenumber as string) || case when l_linenumber = 7 then '.svg' else '.csv' end as requested,
  l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax,
  l_returnflag as flag, l_linestatus as linestatus, {day('l_shipdate')} as ship_day
from {{lineitem}} join {{session_rows}} on l_orderkey = orderkey
"""

REQUEST_KEYS = ["archive", "run_id", "requested"]
REQUEST_ORDER = ["ship_day", "partkey", "suppkey", "quantity", "price", "discount", "tax",
                 "flag", "linestatus"]

TABLES["named"] = f"""
select *, cast(row_number() over (partition by {', '.join(REQUEST_KEYS)}
    order by {', '.join(REQUEST_ORDER)}) as bigint) as pos from {{requests}}
"""

#: The name a file was given, from what was asked for.
FILENAME = f"""case when pos = 1 then requested else
    split_part(requested, '.', 1) || '-' || {digits('pos - 1', 3)} || '.' || split_part(requested, '.', 2)
  end"""

ARTIFACT_COLUMNS = f"""archive, run_id, year, orderkey, custkey, partkey, suppkey, line, tax, discount, flag,
  {FILENAME} as filename,
  requested as display_name,
  case when pos > 1 then requested end as original_name,
  case when pos > 1 then cast(pos - 1 as int) end as duplicate_index,
  ship_day || 'T' || lpad(cast(line + 8 as string), 2, '0') || ':00:00+00:00' as created,
  ship_day || 'T12:00:00+00:00' as mtime,
  partkey * 1000 + line * 7 as size,
  case flag when 'R' then 'external' when 'N' then 'script' end as source,
  case when flag = 'R' then 'lab-' || cast(suppkey as string) end as origin,
  case when flag = 'N' then 'repo-' || cast(suppkey % 7 as string) end as repo,
  case when flag = 'N' then substr({{sha}}(cast(suppkey as string)), 1, 40) end as commit,
  case when flag = 'N' then discount > 0.05 end as dirty,
  case when flag = 'N' then 'scripts/run_' || cast(line as string) || '.py' end as entry_point,
  case when flag = 'N' then 'src' || cast(suppkey % 17 + 8 as string) end as code,
  case when quantity <> 25 then {{sha}}(cast(orderkey as string) || '|' || cast(partkey as string) || '|' || cast(suppkey as string)) end as sha256,
  case when quantity in (17, 34) then {{sha}}('edited|' || cast(orderkey as string) || '|' || cast(partkey as string))
       else {{sha}}(cast(orderkey as string) || '|' || cast(partkey as string) || '|' || cast(suppkey as string)) end as actual_sha256,
  tax <> 0.08 as has_file, discount <> 0.0 as has_sidecar, quantity <> 49 as readable,
  quantity = 50 as trashed, quantity <= 10 as was_renamed"""

TABLES["artifacts"] = f"\nselect {ARTIFACT_COLUMNS}\nfrom {{named}}\n"

TABLES["files"] = """
select archive, run_id, year, filename as name, size, mtime, actual_sha256 as sha256
from {artifacts} where has_file and not trashed
"""

SIDECAR_COLUMNS = """archive, run_id, year, filename, readable, trashed,
  case when readable then created end as created,
  case when readable then source end as source,
  case when readable then origin end as origin,
  case when readable then repo end as repo,
  case when readable then commit end as commit,
  case when readable then dirty end as dirty,
  case when readable then entry_point end as entry_point,
  case when readable then code end as code,
  case when readable then sha256 end as sha256,
  case when readable then original_name end as original_name,
  case when readable then duplicate_index end as duplicate_index"""

TABLES["sidecars"] = f"\nselect {SIDECAR_COLUMNS}\nfrom {{artifacts}} where has_sidecar\n"

TABLES["sidecar_rejects"] = """
select archive, run_id, filename, trashed from {artifacts} where has_sidecar and not readable
"""

# The earliest artifact of each part: what external files were calibrated with.
TABLES["calibrations"] = """
select partkey as cal_part, archive as cal_archive, run_id as cal_session, filename as cal_file, n_part
from (select partkey, archive, run_id, filename,
        row_number() over (partition by partkey order by created, archive, run_id, filename) as r,
        count(*) over (partition by partkey) as n_part
      from {artifacts} where has_sidecar and readable and not trashed) c where r = 1
"""

TABLES["calibrated"] = """
select a.*, c.cal_archive, c.cal_session, c.cal_file
from {artifacts} a join {calibrations} c on a.partkey = c.cal_part
where a.has_sidecar and a.readable and not a.trashed and a.flag = 'R'
"""

_NO = "cast(null as string)"
_OWN = "archive, run_id, filename"

TABLES["edges"] = f"""
select {_OWN}, 0 as ord, {_NO} as ref_user, {_NO} as ref_archive, {_NO} as ref_session,
  case when tax = 0.01 then 'draft-' else 'line-' end || cast(line - 1 as string) || '.csv' as ref_file,
  {_NO} as ref_collection, {_NO} as ref_asset, {_NO} as ref_sha256, {_NO} as ref_fidelity
from {{artifacts}} where has_sidecar and readable and not trashed and line > 1 and duplicate_index is null
union all
select {_OWN}, 1, {_NO}, case when cal_archive <> archive or tax = 0.03 then cal_archive end,
  cal_session, cal_file, {_NO}, {_NO}, {_NO}, {_NO}
from {{calibrated}}
where tax = 0.0 or cal_archive <> archive or cal_session <> run_id or cal_file <> filename
union all
select {_OWN}, 2, {_NO}, {_NO}, {_NO}, 'figure.svg', {_NO},
  case when tax = 0.02 then 'AF-23-' else 'AF-24-' end || {digits('custkey', 4)},
  case when tax <> 0.0 then {{sha}}('{{{{"k": ' || cast(partkey % 120 as string) || '}}}}') end,
  case when discount >= 0.05 then 'pinned' else 'observed' end
from {{artifacts}} where has_sidecar and readable and not trashed and line = 1 and duplicate_index is null
union all
select {_OWN}, 3, {_NO}, {_NO}, substr(run_id, 1, 5) || {digits('orderkey - 1', 8)}, {_NO}, {_NO}, {_NO}, {_NO}, {_NO}
from {{artifacts}} where has_sidecar and readable and not trashed and line = 2 and duplicate_index is null and flag = 'N'
union all
select {_OWN}, 4, case when discount = 0.01 then 'kai@example.org' end,
  case when discount = 0.01 then 'ATLANTIS' else 'MIDDLE EAST' end, 'S-99-0001', 'x.csv', {_NO}, {_NO}, {_NO}, {_NO}
from {{artifacts}} where has_sidecar and readable and not trashed and line = 3 and duplicate_index is null
  and flag = 'A' and discount in (0.01, 0.1)
"""

TABLES["renames"] = """
select archive, run_id, 1 as ord, 'draft-' || cast(line as string) || '.csv' as old_name,
  'temp-' || cast(line as string) || '.csv' as new_name
from {artifacts} where was_renamed and has_file and not trashed and duplicate_index is null
union all
select archive, run_id, 2, 'temp-' || cast(line as string) || '.csv', filename
from {artifacts} where was_renamed and has_file and not trashed and duplicate_index is null
"""

TABLES["assets"] = f"""
select r_name as archive, 'AF-24-' || {digits('c_custkey', 4)} as asset_id, c_custkey as custkey,
  'fig-' || cast(c_custkey as string) || case c_mktsegment when 'AUTOMOBILE' then '.svg'
    when 'BUILDING' then '.png' when 'MACHINERY' then '.csv' else '.tiff' end as name,
  case when c_acctbal < -650 then null
       else 'fig-' || cast(c_custkey as string) || case when c_acctbal > 9500 then '-v2' else '' end
    || case c_mktsegment when 'AUTOMOBILE' then '.svg'
    when 'BUILDING' then '.png' when 'MACHINERY' then '.csv' else '.tiff' end end as live_name,
  case when c_acctbal between -800 and -700 then 'missing'
       when c_acctbal < -950 then 'unreadable' else 'ok' end as record_state,
  '2024-01-0' || cast(1 + c_nationkey % 9 as string) || 'T00:00:00+00:00' as created,
  case when c_acctbal > 1000 then '2024-02-1' || cast(c_nationkey % 10 as string) || 'T00:00:00+00:00' end as scanned_at,
  case c_mktsegment when 'AUTOMOBILE' then 'auto' when 'BUILDING' then 'auto' when 'FURNITURE' then 'every_change'
    when 'HOUSEHOLD' then 'sometimes' end as policy,
  case when c_nationkey < 5 then 2 + c_nationkey end as period_days,
  case when c_nationkey = 7 then 5 end as max_snapshots,
  cast(case when c_nationkey = 8 then 500 end as bigint) as max_snapshot_bytes,
  cast(greatest(cast(round(c_acctbal * 100) as bigint), 0) as bigint) * 20000 as size,
  cast(greatest(cast(round(c_acctbal * 100) as bigint), 0) as bigint) * 20000
    + case when c_acctbal > 9000 then 1 else 0 end as live_size,
  {{sha}}('{{{{"k": ' || cast(c_custkey % 100 as string) || '}}}}') as sha256,
  {{sha}}('{{{{"k": ' || cast(case when c_acctbal > 9300 then 7 else c_custkey % 100 end as string) || '}}}}') as live_sha256
from {{customer}} join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
"""

TABLES["asset_folders"] = "select archive, asset_id from {assets}"
TABLES["asset_records"] = "select archive, asset_id, name from {assets} where record_state = 'ok'"
TABLES["asset_rejects"] = "select archive, asset_id from {assets} where record_state = 'unreadable'"
TABLES["asset_files"] = "select archive, asset_id, live_name from {assets} where live_name is not null"

TABLES["snapshot_rows"] = f"""
select a.archive, a.asset_id, {{sha}}(e.props) as sha256, cast(floor(e.value) as bigint) as bytes,
  {day('e.ts')} as at_day, e.ts as ts, e.event_id as event_id, e.event_type as trigger,
  e.event_type = 'error' as pending_gc
from {{events}} e join {{assets}} a on e.user_id = a.custkey
"""

TABLES["asset_snapshots"] = """
select *, cast(row_number() over (partition by archive, asset_id order by ts, event_id) as bigint) as ord
from {snapshot_rows}
"""

TABLES["asset_blobs"] = """
select {sha}(props) as digest, max(cast(floor(value) as bigint)) as bytes from {events}
where length(props) >= 9 group by {sha}(props)
union all
select {sha}(text), cast(max(length(text)) as bigint) from {conversations} where role = 'system' group by {sha}(text)
"""

TABLES["manifest_files"] = """
select source as manifest, source || '/doc-' || cast(doc_id as string) || '.txt' as path,
  {sha}(text) as blob, n_chars as bytes, lang
from {documents}
"""

TABLES["manifests"] = """
select source as manifest, source || '/main.py' as entry, count(*) * 80 as bytes from {documents} group by source
"""

TABLES["code_blobs"] = """
select {sha}(text) as digest, max(n_chars) as bytes from {documents} where lang <> 'de' group by {sha}(text)
union all
select {sha}(url), cast(max(length(url)) as bigint) from {pages} group by {sha}(url)
"""

TABLES["annotations"] = """
select archive, run_id, filename, 'disc ' || cast(line as string) as tag_a, flag as tag_b,
  'shipped ' || substr(created, 1, 10) as comment
from {artifacts} where discount >= 0.08 and not trashed and duplicate_index is null
union all
select archive, run_id, cast(null as string), tag_b, 'reviewed', 'session of ' || substr(created, 1, 4)
from {session_rows} where tag_a = '1-URGENT'
"""

TABLES["collection_entries"] = """
select cal_archive as archive, p_brand as collection, p_partkey as ord,
  case when p_size = 50 then 'a|b|c' else case p_type
    when 'ECONOMY' then cal_session || '/' || cal_file
    when 'LARGE' then cal_session
    when 'MEDIUM' then cal_archive || '|' || cal_session || '/' || cal_file
    when 'PROMO' then 'collections/set-' || cast(p_size as string)
    when 'SMALL' then 'prov://middle-east@example.org/MIDDLE EAST/' || cal_session || '/' || cal_file
    else cal_session || '/gone-' || cal_file end end as ref,
  p_name as note
from {part} join {calibrations} on p_partkey = cal_part
union all
select 'EUROPE', 'set-' || cast(cast(floor((s_suppkey - 1) / 3) as bigint) as string), s_suppkey,
  'collections/set-' || cast(s_suppkey as string), s_name
from {supplier} where s_suppkey >= 1
union all
select 'EUROPE', 'set-' || cast(s_suppkey as string), s_suppkey,
  'collections/set-' || cast(cast(floor((s_suppkey - 1) / 3) as bigint) as string), 'back to parent'
from {supplier} where s_suppkey >= 1 and s_acctbal < 0
"""

# References as people write them: one spelling per kind of line.
TABLES["ref_texts"] = f"""
select archive, run_id, filename, line,
  case when discount = 0.0 then case line when 1 then '' when 2 then 'a|b|c' when 3 then '|x' when 4 then 'x|'
      when 5 then '/x' when 6 then 'a/b/c' else 'prov://only' end
    when discount = 0.1 then case line when 1 then 'prov://u@x/A/S-24-0001/f/g' when 2 then 'prov://u@x/A/assets'
      when 3 then 'collections/a/b' when 4 then 'AF-24-0007' when 5 then 'assets/AF-24-0009'
      when 6 then 'PROV://u@x/A' else '  EUROPE | S-24-0001 / out.csv  ' end
    else case line when 1 then 'line-1.csv' when 2 then run_id when 3 then run_id || '/' || display_name
      when 4 then archive || '|' || run_id || '/' || display_name
      when 5 then 'prov://kai@example.org/' || archive || '/' || run_id || '/' || display_name
      when 6 then 'collections/set-' || cast(suppkey as string)
      else 'prov://kai@example.org/' || archive || '/collections/set-' || cast(suppkey as string) end
  end as ref
from {{artifacts}} where has_sidecar
"""

TABLES["identities"] = f"""
select c_custkey as custkey, c_nationkey as nationkey,
  case c_mktsegment
    when 'AUTOMOBILE' then substr({digits('c_custkey', 15)}, 1, 4) || '-' || substr({digits('c_custkey', 15)}, 5, 4)
      || '-' || substr({digits('c_custkey', 15)}, 9, 4) || '-' || substr({digits('c_custkey', 15)}, 13, 3)
      || case when c_acctbal < 0 then 'X' when c_acctbal > 9500 then '' else cast(c_custkey % 10 as string) end || '@orcid.org'
    when 'BUILDING' then case when c_acctbal < 0 then 'bad--' else 'user-' end || cast(c_custkey as string) || '@GitHub.com'
    when 'FURNITURE' then 'User-' || cast(c_custkey as string) || '@Lab.Example.ORG'
    when 'HOUSEHOLD' then case when c_acctbal < 0 then 'a b' when c_acctbal > 9000 then 'https://github.com/user'
      else 'user' end || cast(c_custkey as string)
    else case when c_acctbal < -500 then '@x.org' when c_acctbal < 0 then 'kai' || cast(c_custkey as string) || '@localid'
      when c_acctbal > 9500 then 'kai@' when c_acctbal > 9000 then 'me@key' when c_acctbal > 8000 then ' '
      else 'a@b' || cast(c_custkey as string) || '@bench' end
  end as identity
from {{customer}}
"""

TABLES["trail"] = """
select 'pet-' || cast(c_nationkey as string) || '-' || lower(c_mktsegment) as petname, c_custkey as ord,
  'user' || cast(c_custkey % 997 as string) || '@example.org' as id,
  case when c_mktsegment <> 'BUILDING' then 'Nation ' || cast(c_nationkey as string) || ' ' || c_mktsegment end as display
from {customer}
"""

# What a freshness check stats: session records and sidecars, live and as the
# last sweep saw them.
TABLES["live_stats"] = """
select archive, year, run_id, 'session.yaml' as name, cast(length(description) + 100 as bigint) as size, created as mtime
from {session_rows} where record_state <> 'missing' and status <> 'paused'
union all
select a.archive, a.year, a.run_id, filename || '.meta.json', cast(200 + line as bigint), a.created
from {artifacts} a join {session_rows} s on a.orderkey = s.orderkey
where has_sidecar and not trashed and record_state <> 'missing' and status <> 'paused'
"""

TABLES["indexed_stats"] = """
select archive, year, run_id, 'session.yaml' as name, cast(length(description) + 100 as bigint) as size, created as mtime
from {session_rows} where record_state <> 'missing' and created < '2000-06-01'
union all
select a.archive, a.year, a.run_id, filename || '.meta.json',
  cast(200 + line + case when tax = 0.05 and a.archive <> 'AFRICA' and a.year <> 1996 then 1 else 0 end as bigint), a.created
from {artifacts} a join {session_rows} s on a.orderkey = s.orderkey
where has_sidecar and not trashed and record_state <> 'missing' and s.created < '2000-06-01'
"""


def duckdb_sql(name: str) -> str:
    """A projection as the checking engine reads it."""
    return _fill(TABLES[name], "sha256", lambda t: t).replace("{{", "{").replace("}}", "}")


def _fill(template: str, sha: str, ref) -> str:
    """Put engine spellings in; ``{{`` and ``}}`` stay doubled braces."""
    text = template.replace("{sha}", sha)
    for name in (*DRIVER_TABLES, *TABLES):
        text = text.replace("{" + name + "}", ref(name))
    return text


class Catalog:
    """Catalog tables of one data folder; the shared ones are built once."""

    #: Tables many queries read, written to the shared folder on first use. Of the artifacts only what they are made
    #: from is written; hashes, names and times are put together where they are read.
    STAGED = ("session_rows", "named", "calibrations", "edges", "asset_snapshots")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}
        self._made: dict[str, object] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in DRIVER_TABLES and name not in TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            frame = self._build(name)
            self._frames[name] = stage(frame, name) if name in self.STAGED else frame
        return self._frames[name]

    def shared(self, name: str, build) -> DataFrame:
        """A derived table several queries start from, built and written once."""
        if name not in self._frames:
            self._frames[name] = stage(build(), name)
        return self._frames[name]

    def once(self, name: str, make):
        """What several queries use besides tables, made once."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def sidecars_with(self, more: DataFrame) -> DataFrame:
        """Sidecars with the columns ``more`` has for their archive, run_id and filename, null where it has none.

        What is shuffled is what sidecars are made from; hashes and texts are several times as many bytes, and made afterwards.
        """
        node = ["archive", "run_id", "filename"]
        added = ", ".join(c for c in more.columns if c not in node)
        rows = self.named.withColumn("filename", F.expr(FILENAME)).join(more, node, "left").drop("filename")
        artifacts = self._sql(f"select {ARTIFACT_COLUMNS}, {added} from {{named}}", named=rows)
        return self._sql(f"select {SIDECAR_COLUMNS}, {added} from {{artifacts}} where has_sidecar", artifacts=artifacts)

    def _build(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "named":
            # An order's key is part of its session's id, so requests of one name are lines of one order.
            return rank_by_key(self.lineitem, "l_orderkey", self._requests_of, "orderkey", REQUEST_KEYS, F.col("ship_day"),
                               [F.col(c) for c in REQUEST_ORDER], "pos").drop("price", "linestatus")
        if name == "asset_snapshots":
            return rank_in_groups(self.snapshot_rows, ["archive", "asset_id"], F.col("at_day"),
                                  [F.col("ts"), F.col("event_id")], "ord")
        if name == "calibrations":
            return self._first_of_each_part
        if name == "calibrated":
            external = self.artifacts.where("has_sidecar and readable and not trashed and flag = 'R'")
            return attach(external, self.calibrations.withColumnRenamed("cal_part", "partkey"),
                          ["partkey"], "n_part", ["run_id", "filename"], "inner")
        return self._sql(TABLES[name])

    @cached_property
    def _first_of_each_part(self) -> DataFrame:
        first = (
            self.artifacts.where("has_sidecar and readable and not trashed")
            .groupBy("partkey")
            .agg(F.min(F.struct("created", "archive", "run_id", "filename")).alias("f"),
                 F.count("*").alias("n_part"))
        )
        return first.select(
            F.col("partkey").alias("cal_part"), F.col("f.archive").alias("cal_archive"),
            F.col("f.run_id").alias("cal_session"), F.col("f.filename").alias("cal_file"), "n_part")

    def _requests_of(self, lineitem: DataFrame) -> DataFrame:
        return self._sql(TABLES["requests"], lineitem=lineitem)

    def _sql(self, template: str, **given: DataFrame) -> DataFrame:
        used = {n: given[n] if n in given else getattr(self, n) for n in (*DRIVER_TABLES, *TABLES) if "{" + n + "}" in template}
        text = _fill(template, "sha2hex", lambda t: "{" + t + "}")
        return self.spark.sql(_sha_calls(text), **used)


def _sha_calls(text: str) -> str:
    """Spell ``sha2hex(x)`` as Spark's two-argument ``sha2(x, 256)``."""
    out, rest = [], text
    while "sha2hex(" in rest:
        head, rest = rest.split("sha2hex(", 1)
        depth, at = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[at], 0)
            at += 1
        out.append(head + "sha2(" + _sha_calls(rest[: at - 1]) + ", 256)")
        rest = rest[at:]
    return "".join(out) + rest


_catalogs: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, folder: str) -> Catalog:
    """The catalog of one data folder, shared by all queries of a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _catalogs:
        _catalogs[key] = Catalog(spark, folder)
    return _catalogs[key]
