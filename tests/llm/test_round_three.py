"""Filter audit, hard negatives and token files against brute force, on small tables with odd rows."""

import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ROWS, SCHEMA, docs, empty, with_clashes  # noqa: F401 -- fixtures
from tracelake.llm import decontaminate, filter_audit, hard_negatives, lines, mixing, near_dups, repeats, token_files, warc
from tracelake.llm.token_ids import MARK, TokenIds


def failing(rows):
    """Letters each row fails, by the rules read off the words."""
    out = []
    for doc, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        copied = doc is not None and any((o or "") == t and d is not None and d < doc for d, o, *_ in rows)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), copied)
        out.append({x for x, bad in zip("ABCDE", tests) if bad})
    return out


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, fails = {}, failing(rows)
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [d for d, f in own if x in f and not f & before]
                removed[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not f & (before | {x}) for _, f in own), len(gone), sum(x in f and bool(f & before) for _, f in own),
                    sum(f == {x} for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, k), figures in out.items():
            if p == part:
                figures.append(removed[order[k - 1]])
    return out


def test_filter_audit_is_that_of_brute_force(spark, docs, empty):  # noqa: F811
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 108, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    more = ROWS + [(200, "A" * 50 + " word" * 120, "en", "s"), (201, "A" * 50 + " word" * 120, "", "s"), (199, None, "en", "s")]
    some = with_clashes(spark.createDataFrame(more, SCHEMA)).withColumns({c: F.lit(1) for c in ("t", "mask", "n", "digest", "part")}).repartition(3)
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.filter_interactions(some, table).collect()}
    assert got == brute_audit(more, labels)
    assert filter_audit.filter_interactions(empty, table).count() == 0
    nothing = spark.createDataFrame([], table.schema)
    assert filter_audit.filter_interactions(docs, nothing).agg(F.sum("good_lost")).first()[0] == 0


def test_an_audit_takes_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 8), ("XY", 2): (5, 0, 2, 2), ("YX", 1): (8, 2, 0, 2), ("YX", 2): (5, 3, 2, 8)}


def brute_negatives(rows, anchor, positives, negatives):
    fit = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit[i, label, tuple(math.floor(x * 256) for x in v)] = None
    out = []
    for a in fit:
        if not anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r) for r in fit if r != a]
        near = sorted((s, r[0]) for s, r in scored if r[1] == a[1])[:positives]
        far = sorted((s, r[0]) for s, r in scored if r[1] != a[1])
        for p, name in near:
            hits = [(s, n) for s, n in far if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a[0], name, k + 1, n, -p, -s) for k, (s, n) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_block", [7, 2000])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, rows_a_block):
    rng = random.Random(5)
    monkeypatch.setattr(hard_negatives, "FEW_ROWS", rows_a_block)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", rows_a_block * 8 * 6)
    base = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, i % 3, [x + rng.choice([0, 0.25, 0.5, -0.25]) for x in base]) for i in range(90)]
    rows += [rows[3], rows[3], (500, 1, []), (501, 1, base[:2]), (502, None, base), (503, 1, None), (504, 1, [None] * 6),
             (505, 1, [math.nan] * 6), (506, 1, [math.inf] + base[1:]), (None, 1, base), (-10, 2, base), (507, 0, [-x for x in base])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    clashing = table.withColumns({c: F.lit(1) for c in ("tag", "v", "cell", "score", "slot", "a", "r", "nth")}).repartition(4)
    got = hard_negatives.hard_negatives(clashing, F.col("vec_id") % 10 == 0, negatives=4)
    want = brute_negatives(rows, lambda i: i % 10 == 0, 5, 4)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.hard_negatives(clashing.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_of_huge_components_are_exact(spark):
    one = np.array([[1 << 40, 3], [1 << 62, 1]], np.int64)
    assert hard_negatives.products(one[:1], one[:1]).tolist() == [[hard_negatives.LARGEST]]
    assert hard_negatives.products(np.array([[1 << 30, 1]]), np.array([[1 << 30, -1]])).tolist() == [[(1 << 60) - 1]]


def whole_ids(texts, end):
    model = TokenIds("word_bpe_49k.json").model
    return [e.ids + [end] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_tokenized_together_are_those_of_the_library():
    texts = ["", None, " \n", f"a {MARK} b{MARK}c", "naïve É é ## 日本  x", "<|endoftext|> hi", "don't 12 it's", "é a b", *[r[1] for r in ROWS]]
    ids, ends = TokenIds("word_bpe_49k.json").encode(pa.array(texts), 7)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == whole_ids(texts, 7)


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_token_files_hold_what_was_written(spark, docs, empty, tmp_path, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(token_files, "LEAST_FILE", 4000)
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    clashing = docs.withColumns({c: F.lit(1) for c in ("ids", "row", "tie", "width", "number")})
    got = token_files.token_files(clashing).collect()
    kept = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    names = [d for _, d, _, _ in kept]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0)) and len(kept) == len(ROWS)
    assert [s for s, *_ in kept] == [sum(k[2] for k in kept[:i]) for i in range(len(kept))]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((d, ids) for _, d, _, ids in kept), key=key) == sorted(zip([r[0] for r in ROWS], whole_ids([r[1] for r in ROWS], 2)), key=key)
    assert token_files.token_files(empty).count() == 0


def test_any_block_is_read_alone_and_damage_is_met(spark, docs, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_files, "LEAST_FILE", 1 << 30)
    files = token_files.write_token_files(docs, f"file://{tmp_path}/out").collect()
    assert sum(f.tokens for f in files) == sum(map(len, whole_ids([r[1] for r in ROWS], 2)))
    path = files[0].path
    for offset, size, before, tokens in reversed(token_files.checkpoints(path)):
        _, lens, ids = token_files.read_block(path, offset, size)
        assert lens.sum() == len(ids) and before + len(ids) <= tokens
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[offset + size // 2] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_block(path, offset, size)
    open(name, "wb").write(data[:-5])
    with pytest.raises(ValueError, match="cut off"):
        token_files.checkpoints(path)


def test_coder_round_trips_and_comes_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 200_000), 40_000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    table = token_files.scaled({int(s): int(n) for s, n in zip(symbols, counts)})
    assert int(table.freqs.sum()) == 1 << token_files.SCALE and table.freqs.min() >= 1
    coder = token_files.Coder(token_files.Table.unpacked(table.packed()))
    for n, lanes in ((1, 1), (5, 2), (1000, 7), (len(ids), 1024)):
        states, words = coder.encode(ids[:n], lanes)
        assert (coder.decode(n, states, words) == ids[:n]).all()
    entropy = -(counts / len(ids) * np.log2(counts / len(ids))).sum()
    assert 32 * len(words) < 1.02 * entropy * len(ids)
    lone = token_files.Coder(token_files.scaled({9: 10 ** 9}))
    assert (lone.decode(10, *lone.encode(np.full(10, 9, np.uint32), 3)) == 9).all()
    many = token_files.scaled({i: 10 ** 12 if i == 3 else 1 for i in range(49_408)})
    assert int(many.freqs.sum()) == 1 << token_files.SCALE


def test_checksums_of_ids_are_unsigned(spark, docs):  # noqa: F811
    got = token_files.token_files(docs.where("doc_id = 106")).withColumn("c", F.crc32("ids")).first()
    assert got.c == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in whole_ids(["one"], 2)[0]))


def test_headers_of_any_length_are_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 1 << 16)
    rng = random.Random(2)
    long = "https://x.example/" + "".join(rng.choice("abcdefgh0123456789") for _ in range(3_500_000))
    pages = spark.createDataFrame([(1, long, "p" * 200), (2, "https://y.example/", "p" * 200), (3, None, "q")], "page_id long, url string, html string")
    got = {r.page_id: (r.uri, r.record_type, r.refers_to) for r in warc.archived_pages(pages, split_bytes=1 << 20).collect()}
    assert got == {1: (long, "response", None), 2: ("https://y.example/", "revisit", 1), 3: ("", "response", None)}


def test_a_record_that_breaks_off_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://x.example/" + "ab1c" * 9, "p" * 200)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/w").first().path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:120])
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records_in(f"file://{path}", 0, 120, False))


def test_ranges_of_an_archive_go_to_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w").collect()
    records = warc.read_archives(spark, f"file://{tmp_path}/w", 4096)
    assert records.select("page_id").distinct().count() == 400
    assert records.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4


def test_ids_of_any_size_are_returned(spark):
    passage = "".join(f"a passage {k} " for k in range(20))
    top = (1 << 63) - 1
    rows = [(1 << 62, passage), (top, passage), (None, passage), (-5, "x" + passage)]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-5: 0, 1 << 62: len(passage), top: len(passage), None: len(passage)}


def plain_groups(texts, words, percent):
    """Components of the documents, every pair compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def test_buckets_of_unlike_documents_are_settled_by_rare_shingles(spark, monkeypatch):
    """Many documents that share a passage of four fifths: all share buckets, few are similar enough."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(110)]
    texts = [" ".join([*passage, *(word() for _ in range(rng.choice([14, 18, 26])))]) for _ in range(60)]
    texts += [" ".join([*t.split()[:-3], word()]) for t in texts[:12]]
    made = []
    rare = near_dups.rare_pairs
    monkeypatch.setattr(near_dups, "rare_pairs", lambda *a: made.append(rare(*a).cache()) or made[-1])
    monkeypatch.setattr(near_dups, "TRIES", 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(rows, words=2).collect()}
    tops, first = plain_groups(texts, 2, 80), {}
    for i, t in enumerate(tops):
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in enumerate(tops)}
    assert made and made[0].count() < 60 * 59 / 4, "far fewer than all pairs of the bucket"


def test_texts_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    import corpus_pipeline

    one, two = " ".join(f"first{i}" for i in range(60)), " ".join(f"second{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, two), (3, one + " more"), (None, two), (None, None), (1, one), (4, "")]
    made = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or -1, r.text_key, r.component_id) for r in near_dups.near_duplicates(made).collect())
    assert len(got) == len(rows) and {c for _, _, c in got if c > 0} == {1, 4}
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, made, str(tmp_path)).collect()]
    assert sorted(t or "" for _, t in kept) == ["", "", one, two] and len(kept) == 4


def test_windows_beyond_a_broadcast_give_the_same_hits(spark, docs, monkeypatch):  # noqa: F811
    words = re.findall(r"[a-z0-9]+", (ROWS[1][1] or "").lower())
    items = [(1, " ".join(words[5:30])), (2, " ".join(words[8:20])), (3, "one!"), (4, None), (None, "another text of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "text_key", "n_words", "windows", "items"]
    some = sorted(map(str, decontaminate.hits(docs, bench).select(*columns).collect()))
    for name, bound in (("BROADCAST_WINDOWS", 0), ("BROADCAST_BYTES", 1)):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, bound)
            got = decontaminate.hits(docs, bench)
            assert sorted(map(str, got.select(*columns).collect())) == some
            assert decontaminate.hits(docs.limit(0), bench).count() == 0
    assert any("i=" in x for x in some)


def test_columns_of_any_names_pass_through(spark):
    names = ["_d", "_k", "_w", "__d", "__k", "__w", "__host", "__dropped", "__kept", "host", "dropped", "row", "kept", "whole", "n_lines"]
    line = "one two three four five six seven eight nine ten"
    rows = [(i, f"{line}\nown {i}", "h", *names) for i in range(8)] + [(9, None, None, *names)]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"{n} string" for n in names)]))
    done = lines.site_line_dedup(table).orderBy("doc_id").collect()
    assert [r.text for r in done] == [f"own {i}" for i in range(8)] + [None]
    assert [(r.n_lines, r.n_dropped) for r in done] == [(2, 1)] * 8 + [(0, 0)]
    assert all(r[n] == n for r in done for n in names if n != "n_lines")
    found = decontaminate.hits(table, spark.createDataFrame([(1, line)], "item_id long, text string"))
    assert [r.doc_id for r in decontaminate.clean_documents(table, found).collect()] == [9]
    cut = decontaminate.without_spans(table, found)
    assert cut.columns == table.columns and {r.text for r in cut.collect()} == {f"\nown {i}" for i in range(8)} | {None}


def test_slots_are_counted_over_all_training_texts(spark):
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(("red", "green", "blue", "x1")) for _ in range(rng.randrange(30))),) for _ in range(40)]
    code = mixing.huffman(np.arange(256))
    table = spark.createDataFrame(texts, "text string").selectExpr("cast(text as binary) as text")
    parts = table.where("length(text) % 3 = 0"), table.where("length(text) % 3 <> 0")
    got = mixing.slot_counts(parts[1], code, mixing.slot_counts(parts[0], code))
    want = [np.zeros(2 << s, np.uint32) for s in mixing.SIZES]
    for t, in texts:
        bits = mixing.Bits([mixing.coded(t.lower().encode().split())], code)
        for j, counts in enumerate(want):
            for slot, bit in zip(bits.slots(j, bits.byte, bits.node).tolist(), bits.bit.tolist()):
                counts[2 * slot + bit] += 1
    blocks = dict(enumerate(np.concatenate([w.reshape(-1, 2 * mixing.BLOCK) for w in want])))
    found = {r.block: mixing.unpacked(r.counts) for r in got.collect()}
    assert sorted(found) == [k for k, b in blocks.items() if b.any()]
    assert all((found[k] == blocks[k]).all() for k in found)
    assert all((x == mixing.inputs(w)).all() for x, w in zip(mixing.trained_tables(got), want))


def test_python_gets_texts_in_batches_bounded_by_bytes(spark):
    from tracelake.llm import common

    sizes = []
    rows = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('x', 4000) as text")

    def size(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    seen = common.per_batch(rows, size, "n long", limit=1 << 30)
    sizes = [r.n for r in seen.collect()]
    spark.conf.unset(name)
    assert sum(sizes) == 6000 and max(sizes) * 4000 < 2 * common.BATCH_BYTES
