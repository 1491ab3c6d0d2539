"""The registered queries of the operators, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    decontaminate, filter_audit, hard_negatives, language, lines, mixing, near_dups, packing, quality, repeats, token_counts,
    token_files, warc,
)
from tracelake.llm.common import benchmark, documents, embeddings, labels, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 100-byte strings that stand earlier in the corpus."""
    return repeats.remove_repeats(documents(spark, folder))


SQL["op1_suffix_dedup"] = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
s as materialized (select doc_id, i, substr(x, (2 * i + 1)::bigint, 200) as t
      from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) as i from d)),
ranked as (select doc_id, i, row_number() over (partition by t order by doc_id, i) as k from s),
again as materialized (select doc_id, i from ranked where k > 1),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run
         from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from again)),
spans as materialized (select doc_id, run, min(i) as b, max(i) + 100 as e from runs group by doc_id, run),
gaps as (
    select doc_id, e as f, coalesce(lead(b) over (partition by doc_id order by b), 1000000000) as u from spans
    union all select d.doc_id, 0, coalesce(m.b, 1000000000) from d left join (select doc_id, min(b) as b from spans group by doc_id) m using (doc_id)),
kept as (select d.doc_id, sha256(unhex(string_agg(substr(x, (2 * f + 1)::bigint, (2 * (u - f))::bigint), '' order by f))) as kept_sha256
         from gaps join d using (doc_id) group by d.doc_id),
n as (select doc_id, sum(e - b)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       kept_sha256
from d join kept using (doc_id) left join n using (doc_id)
"""


@query
def op2_warc_splittable(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives and read back by byte ranges."""
    return warc.archived_pages(pages(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc_splittable"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first_id is null or f.first_id is not distinct from d.page_id then 'response' else 'revisit' end as record_type,
       case when f.first_id is distinct from d.page_id then f.first_id end as refers_to
from d left join f using (payload_digest)
"""


@query
def op4_site_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that their source repeats on more than a twentieth of its documents."""
    done = lines.site_line_dedup(documents(spark, folder))
    return done.select("doc_id", "n_lines", "n_dropped", "text")


SQL["op4_site_line_dedup"] = """
with each_line as (
    select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
           generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
bare as (select *, trim(line, ' ' || chr(9) || chr(13)) as b from each_line),
totals as (select source, count(*) as pages from documents group by source),
held as (select source, b, count(distinct doc_id) as n from bare where b <> '' group by source, b),
boiler as (
    select held.source, b, true as boiler from held join totals on held.source is not distinct from totals.source
    where n >= 5 and n > pages * 0.05),
marked as (
    select bare.*, coalesce(boiler.boiler, false) as gone
    from bare left join boiler on bare.source is not distinct from boiler.source and bare.b = boiler.b)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
from marked group by doc_id
"""


@query
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words found in documents."""
    found = decontaminate.hits(documents(spark, folder), benchmark(spark, folder))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("windows") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op6_decontaminate"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select item_id, least(len(w), 10) as n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as t from bw),
sizes as (select distinct n from windows),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
found as (select dw.doc_id, dw.i, dw.n, windows.item_id from dw join windows
          on dw.n = windows.n and array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ') = windows.t),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
          from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(listed, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@query
def op7_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules of documents and of their hosts."""
    return quality.host_quality(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs",
        "host_bad")


SQL["op7_host_quality"] = r"""
with d as (select doc_id, source, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
tri as (select doc_id, i, count(*) over (partition by doc_id, x) as n
        from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x
              from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d))),
rep as (select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest([i, i + 1, i + 2]) as p from tri where n > 1) group by doc_id),
ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
       from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
       where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
f as (select d.doc_id, d.source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters
      from d left join rep using (doc_id) left join ln using (doc_id)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines or 100 * n_upper > 50 * n_letters as other from f),
h as (select source, count(*) as host_docs, count(*) filter (base_failed or other) as bad from j group by source),
m as (select least(greatest(avg(bad / host_docs), 1e-6), 1 - 1e-6) as mean, var_pop(bad / host_docs) as v, count(*) as n from h),
s as (select mean, greatest(case when n > 1 and v > 0 then mean * (1 - mean) / v - 1 else 1 end, 1) as k from m),
hv as (select source, host_docs, (bad + mean * k) / (host_docs + k) > 0.5 as host_bad from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or other or host_bad) as kept, host_docs, host_bad
from j join hv on j.source is not distinct from hv.source
"""


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by merging pairs."""
    return token_counts.token_counts(documents(spark, folder))


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into sequences of at most 4096 tokens."""
    return packing.best_fit_packing(documents(spark, folder), with_ids=False)


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, from its text, its declaration and its host."""
    return language.language_id(documents(spark, folder)).drop("text_key")


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose sets of two-word shingles are similar to 0.8 or more, by components."""
    return near_dups.near_duplicates(documents(spark, folder), words=2).select("doc_id", "n_shingles", "component_id", "kept")


SQL["op3_near_duplicates"] = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
    select distinct doc_id, array_to_string(w[i:i + 1], ' ') as x
    from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id
           group by a.doc_id, b.doc_id),
links as materialized (
    select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
edges as materialized (select a, b from links union all select b, a from links),
reach(v, u) as (select doc_id, doc_id from documents union select reach.v, edges.b from reach join edges on reach.u = edges.a),
comp as (select v, min(u) as component_id from reach group by v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n on n.doc_id = d.doc_id join comp on comp.v = d.doc_id
"""


@query
def op5_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and context-mixing scores of every document, learnt from six sevenths of them."""
    return mixing.lm_scores(documents(spark, folder))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at each place of each order, by language."""
    return filter_audit.filter_interactions(documents(spark, folder), labels(spark, folder))


SQL["op11_filter_audit"] = r"""
with w as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select doc_id, part,
             case when len(w) < 100 then 1 else 0 end
             + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
             + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
             + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
             + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
      from w),
told as (select doc_id, max(quality) filter (quality = 1) as good, max(toxic) filter (toxic = 1) as toxic from labels group by doc_id),
cells as materialized (
    select part, mask, count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic
    from m left join told using (doc_id) group by part, mask),
letters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
           where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, s.step, f, bit,
                 (select coalesce(sum(l.bit), 0) from letters l where strpos(substr(filter_order, 1, s.step - 1), l.f) > 0)::integer as earlier
          from orders, (select unnest(range(1, 6)) as step) s, letters where substr(filter_order, s.step, 1) = f),
figures as (
    select part, filter_order, step, f,
           coalesce(sum(n) filter (mask & (earlier | bit) = 0), 0)::bigint as kept,
           coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as removed,
           coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier <> 0), 0)::bigint as redundant,
           coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
           coalesce(sum(good) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as good_lost,
           coalesce(sum(toxic) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as toxic_lost
    from cells, steps group by part, filter_order, step, f)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from figures
"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of other labels that score a little below an anchor's positives; a seventh of the labels are made wrong."""
    rows = embeddings(spark, folder)
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", wrong.alias("label")), F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
with v as materialized (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.e, r.e)::bigint as score
    from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id))::integer as rank,
       s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) <= 10
"""


@query
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to files by ascending id and read back."""
    return token_files.token_files(documents(spark, folder)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
