"""The operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, language, lines, mixing, near_dups, packing, quality, repeats, token_counts, warc

#: Names that the operators use themselves, as further columns of the input.
CLASHING = ("node", "tie", "h", "at", "text_key", "host", "suffix", "band", "rep", "w", "i", "items", "window", "len", "token")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def made_documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeiou") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["é", "Ü#", "été"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(80) for _ in range(5)]
    rows = []
    for i in range(60):
        t = base[i % 5].split() if i % 3 else text(rng.randint(1, 90)).split()
        if i % 4 == 0:
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t) + ("\nshared line of a site" if i % 2 else ""), "en" if i % 7 else "fr", f"s{i % 3}.example.fr"))
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \n\t ", "en", "s1"), (103, base[0], None, "s2"),
             (104, base[0], "en", None), (104, base[0], "en", None), (104, "another text of one id", "en", "s1"),
             (None, base[1], "en", "s1"), (None, None, None, None), (105, "a" * 3000 + " " + "ab" * 900, "fr", "s2"),
             (106, "one", "fr", "s2"), (107, text(6000), "en", "s1")]
    return rows


ROWS = made_documents()
SCHEMA = "doc_id long, text string, lang string, source string"


def with_clashes(df):
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


def distinct_rows():
    """Rows that have an id of their own, as the contracts' brute force needs them."""
    seen = Counter(r[0] for r in ROWS)
    return [r for r in ROWS if r[0] is not None and seen[r[0]] == 1]


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = [True] * 100
            seen.add(b[p:p + 100])
        runs = sum(g and not (q and gone[q - 1]) for q, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("alphabet, block, crowd", [("ab", 4096, 10 ** 6), ("abcdé ", 7, 10 ** 6), ("abcd", 4096, 3)])
def test_repeats(spark, monkeypatch, alphabet, block, crowd):
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(200, 600))) for _ in range(4)]
    rows = []
    for i in range(50):
        cuts = [sorted((rng.randint(0, 500), rng.randint(0, 600))) for _ in range(rng.randint(0, 3))]
        rows.append((3 * i - 50, "".join(rng.choice(base)[a:b] + rng.choice(["", "-", "xyz"]) for a, b in cuts)))
    rows += [(500, None), (501, ""), (502, "a" * 700), (503, "ab" * 300), (504, "a" * 99)]
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = repeats.remove_repeats(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == brute_repeats(rows)


def test_maximal_repeats_list_all_occurrences():
    import numpy as np

    left, right = b"L" * 68, b"anchor" * 20
    texts = [left[:-1] + bytes([c]) + right[:100] for c in b"xyzx"]
    got = list(repeats.maximal_repeats(np.zeros(4, np.int64), np.full(4, 68), np.zeros(4, np.int64), texts))
    assert (100, [0, 1, 2, 3]) in [(n, sorted(rows.tolist())) for n, rows, _, _ in got]
    assert (168, [0, 3]) in [(n, sorted(rows.tolist())) for n, rows, _, _ in got]


def test_odd_rows_of_repeats(docs, empty):
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert [r.n_removed for r in got if r.doc_id == 104 and r.n_bytes > 50] == [len(ROWS[-9][1].encode())] * 2
    assert repeats.remove_repeats(empty).count() == 0


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 64)
    big = "<p>" + "payload " * 40
    rows = [(i, f"http://a.example/{i}", big + str(i % 4) if i % 2 else f"small {i % 3}") for i in range(40)]
    rows += [(50, None, None), (51, "http://b", ""), (None, "http://c", big + "1"), (60, "http://d", "é" * 5000), (60, "http://d", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = warc.archived_pages(pages, split_bytes=300).collect()
    payload = lambda r: (r[2] or "").encode()
    first = {}
    for r in rows:
        if len(payload(r)) >= 100 and r[0] is not None:
            first[payload(r)] = min(r[0], first.get(payload(r), r[0]))
    want = Counter()
    for r in rows:
        p = payload(r)
        to = first.get(p)
        to = None if to == r[0] else to
        want[(r[0], len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_archives_keep_payloads_and_any_split_reads_each_record_once(spark, tmp_path):
    rows = [(i, "http://x", f"text {i} " * (1 + i % 9)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", least=10 ** 9)
    for split in (50, 777, 1 << 20):
        got = {r.page_id: r.payload.decode() for r in warc.read_archives(spark, f"{tmp_path}/w", split).collect()}
        assert got == {r[0]: r[2] for r in rows}


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {b" ".join(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t, _, _ in distinct_rows()]
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 120)))]
        for k in range(12):
            copy = [w if rng.random() > 0.03 * (k % 4) else rng.choice(vocabulary) for w in base]
            rows.append((1000 + 50 * g + k, " ".join(copy)))
    got = near_dups.near_duplicates(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")), words=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_near(rows, 2, 80)


def test_odd_rows_of_near_duplicates(docs, empty):
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.kept and r.component_id == r.node for r in got if not r.n_shingles)
    assert near_dups.near_duplicates(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101)]
    got = near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.to, set()).add(r.v)
    assert sorted(map(sorted, parts.values())) == [list(range(41)), [100, 101, 102, 103]]


def test_site_lines(docs, empty):
    got = lines.site_line_dedup(docs, max_ratio=0.3, min_pages=3).collect()
    pages, held = Counter(r[3] for r in ROWS), Counter()
    for r in ROWS:
        held.update((r[3], x) for x in {x.strip(" \t\r") for x in (r[1] or "").split("\n")} if x)
    bad = lambda s, x: x.strip(" \t\r") and held[s, x.strip(" \t\r")] >= 3 and held[s, x.strip(" \t\r")] > 0.3 * pages[s]
    want = Counter()
    for i, t, _, s in ROWS:
        kept = None if t is None else [x for x in t.split("\n") if not bad(s, x)]
        n = 0 if t is None else t.count("\n") + 1
        want[i, None if t is None else "\n".join(kept), n, 0 if t is None else n - len(kept)] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert any(r.n_dropped for r in got)
    assert lines.site_line_dedup(empty).count() == 0


def test_context_mixing(docs, empty):
    got = mixing.lm_scores(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for i, t, _, _ in ROWS:
        if not held(i):
            count.update([*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, _, _ in ROWS:
        tokens = [*words(t), b"\n"]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        want[i, held(i), len(tokens), sum(count[x] > 0 for x in tokens), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-math.inf < r.score < 0 for r in got)
    assert mixing.lm_scores(empty).count() == 0


def test_mixing_is_a_distribution_and_does_not_depend_on_the_batch():
    import numpy as np

    code = mixing.huffman(np.arange(256))
    rng = np.random.default_rng(1)
    model = [rng.integers(-4000, 4000, 1 << s).astype(np.int16) for s in mixing.SIZES]
    start = np.full((mixing.GATES, mixing.TABLES), 0.3)

    def scores(texts):
        bits = mixing.Bits(texts, code)
        return mixing.text_scores(bits, mixing.mixed(bits, model, start, 5))

    every = scores([b"same start " + bytes([c]) for c in range(256)])
    assert abs(sum(10 ** (every - scores([b"same start "])[0])) - 1) < 1e-3
    alone = [scores([t])[0] for t in (b"abc def\n", b"x\n", b"\n")]
    assert np.allclose(alone, scores([b"abc def\n", b"x\n", b"\n"]), atol=1e-5)


def test_decontamination(spark, docs, empty):
    words_of = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    long = " ".join(words_of(ROWS[1][1])[k].decode() for k in range(5, 30))
    items = [(1, long), (10, "  One! "), (2, long.upper().replace(" ", ", ")), (3, None), (4, ""), (5, "another TEXT of"), (None, "no such words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hits(docs, bench)
    got = Counter((r.doc_id, r.n_words, r.h, tuple(r["items"])) for r in found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("h"), "items").collect())
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - min(len(w), 10) + 1) if w else ():
            windows.setdefault(tuple(w[k:k + 10]), set()).add("" if i is None else str(i))
    want = Counter()
    for i, t, _, _ in ROWS:
        w = words_of(t)
        hit, names = set(), set()
        for x, of in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names |= of
        want[i, len(w), len(hit), tuple(sorted(names))] += 1
    assert got == want and any(k[2] for k in got)
    clean = decontaminate.clean_documents(docs, found)
    assert clean.count() == sum(n for k, n in want.items() if not k[2])
    assert clean.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(docs, found).collect()}
    assert cut[106] == "" and cut[1] != ROWS[1][1] and cut[3] == ROWS[3][1]
    assert decontaminate.hits(empty, bench).count() == 0
    assert not decontaminate.hits(docs, bench.limit(0)).where("size(windows) > 0").count()


def test_quality(docs, empty):
    got = quality.host_quality(docs).collect()
    want = Counter()
    for i, t, _, _ in ROWS:
        w = WORD.findall((t or "").encode())
        three = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if three[tuple(w[k:k + 3])] > 1 for j in range(3)}
        full = [x for x in (t or "").split("\n") if x.strip(" \t\r\n\v\f")]
        want[i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(rep),
             len(w) < 50 or 2 * len(rep) > len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.host_quality(empty).count() == 0


def test_bad_hosts_condemn_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(30)] + [(200, good, "bad"), (300, good, "new")]
    got = {r.doc_id: r.kept for r in quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not got[200] and got[300]
    assert quality.beta_prior(1, 0.2, 0.0) == (0.2, 0.8)


def test_token_counts(docs, empty):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = lambda t: len(library.encode(t or ""))
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, limit=200).collect())
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 200) for i, t, _, _ in ROWS)
    counter = token_counts.counter("piece_bpe_32k.model")
    rng = random.Random(2)
    odd = ["  a  b ", "<s> </s>", "▁▁a ▁", "a　b", "😀 é́ ﬁ\t", "\r\r\r\n", "a\x00b", "a" * 5000]
    odd += ["".join(rng.choice("abcde ▁THE\n\té😀,.'") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    assert [counter.count(t) for t in odd] == [n(t) for t in odd]
    assert token_counts.token_counts(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    capacity = 64
    got = packing.best_fit_packing(docs, capacity=capacity).collect()
    want = Counter()
    for i, t, _, _ in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    free = []
    for size in sorted((k[3] for k in want.elements()), reverse=True):
        fits = [(room, j) for j, room in enumerate(free) if room >= size]
        if fits:
            free[min(fits)[1]] -= size
        else:
            free.append(capacity - size)
    assert len(places) == len(free)
    assert packing.best_fit_packing(empty).count() == 0


def test_language(spark, docs, empty):
    en, fr = "the cat and the dog went through that thing with others ", "le chat et la souris étaient dans une maison très éloignée "
    rows = [(i, (fr if i % 3 else en) * (1 + i % 4), "fr" if i % 3 else "en", "a.example.fr") for i in range(60)]
    rows += [(100, fr * 3, "en", "b.example.com"), (101, "", "fr", "c.fr"), (102, None, None, None), (103, "12 34", "en", "c.fr"), (104, en, None, None)]
    got = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].language == ("fr" if i % 3 else "en") and got[i].kept for i in range(60))
    assert got[100].language == "fr" and got[104].language == "en"
    assert not any(got[i].kept for i in (101, 102, 103))
    assert language.language_id(docs).count() == len(ROWS)
    assert language.language_id(empty).count() == 0
    page = spark.createDataFrame([(1, "https://www.Example.DE:80/x", '<html class=a lang="de-AT"><script>var x</script><p>Guten <b>Tag')],
                                 "page_id long, url string, html string")
    assert [(r.lang, r.source, r.text.split()) for r in language.page_evidence(page).collect()] == [("de", "www.example.de", ["Guten", "Tag"])]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 107 in ids and not ids & {100, 101, 102}, "texts without letters go, others stay"
    assert len([r for r in out if r.doc_id == 104 and r.piece == 0]) <= 1, "a repeated row is one document"
    none = corpus_pipeline.in_language(spark, docs.limit(0), str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[1:]:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def test_copies_are_left_to_near_dedup(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    line = lambda n=12: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    copied = [line() for _ in range(8)]
    rows = [(i, "\n".join(["menu of the site", *copied]), "en", "s") for i in range(20)]
    rows += [(20 + i, "\n".join(["menu of the site", *copied[:7], copied[7] + f" x{i}"]), "en", "s") for i in range(10)]
    rows += [(100 + i, "\n".join(["menu of the site", line(), line()]), "en", "s") for i in range(60)]
    rows += [(200 + i, "menu of the site", "en", "s") for i in range(3)]
    made = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    clean = corpus_pipeline.without_boilerplate(spark, made, str(tmp_path))
    got = {r.doc_id: r.text for r in clean.collect()}
    assert all(got[i] == t.removeprefix("menu of the site\n") for i, t, _, _ in rows)
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_near_duplicates(spark, clean, str(tmp_path)).collect()}
    assert set(kept) == {0, *range(100, 160), 200} and kept[0] == "\n".join(copied)


def test_mixing_carries_weights_through_the_whole_text(spark, docs, monkeypatch):
    import numpy as np

    code = mixing.huffman(np.arange(256))
    rng = np.random.default_rng(2)
    model = [rng.integers(-4000, 4000, 1 << s).astype(np.int16) for s in mixing.SIZES]
    start = np.full((mixing.GATES, mixing.TABLES), 0.3)
    texts = [b"one two three four " * 40 + b"\n", b"x" * 300 + b" y\n", b"\n", b"short text\n"]

    def one_by_one(text):
        bits = mixing.Bits([text], code)
        x, gate = mixing.gated(model, bits, bits.byte, bits.node)
        weights, total = start.astype(np.float32), 0.0
        for xi, g, bit in zip(x, gate, bits.bit.tolist()):
            p = 1 / (1 + math.exp(-min(max(float(xi @ weights[g]), -mixing.MAX_LOGIT), mixing.MAX_LOGIT)))
            total += math.log10(p if bit else 1 - p)
            weights[g] += np.float32(mixing.RATE * (bit - p)) * xi
        return total

    for piece in (50, 10 ** 6):
        monkeypatch.setattr(mixing, "PIECE", piece)
        assert np.allclose(mixing.whole_scores(texts, code, model, start), [one_by_one(t) for t in texts], rtol=1e-4)
    for r in mixing.lm_scores(docs).collect():
        assert abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-6


def test_texts_in_no_known_language_are_rejected(spark):
    rng = random.Random(8)
    vocabulary = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(150)]
                  for x, a in (("en", "etaoinshr"), ("fr", "eaisunlré"), ("xx", "kwzyqjvgx"))}
    text = lambda x, n=60: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    rows = [(i, text("fr" if i % 3 else "en"), "fr" if i % 3 else "en", "s") for i in range(300)]
    rows += [(1000 + i, text("xx"), "xx" if i < 5 else None, "s") for i in range(20)]
    rows += [(2000, "x#$%&*|<> 9q" * 9, None, "s"), (2001, "qzxv jkwq " * 9, None, "s")]
    got = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept and got[i].language == ("fr" if i % 3 else "en") for i in range(300))
    assert not any(r.kept or r.language for i, r in got.items() if i >= 1000)


def test_every_language_with_enough_labelled_rows_has_a_model(spark):
    rng = random.Random(9)
    rows = []
    for k in range(70):
        vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(25)]
        rows += [(100 * k + i, " ".join(rng.choice(vocabulary) for _ in range(60)), f"l{k:02}", "s") for i in range(12)]
    got = language.language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.kept and r.language == r.declared for r in got)


def test_packing_and_repeats_return_contents(spark):
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    passage = "".join(f"passage {k} " for k in range(20))
    rows = [(1, "a " + passage + "z"), (2, passage + "é end"), (3, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {}
    for r in sorted(packing.best_fit_packing(made, capacity=16).collect(), key=lambda r: r.piece):
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        ids[r.doc_id] = ids.get(r.doc_id, ()) + struct.unpack(f"<{r.length}I", r.ids)
    assert ids == {i: (*library.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows}
    got = {r.doc_id: (bytes(r.kept).decode(), [tuple(s) for s in r.spans]) for r in repeats.kept_texts(made).collect()}
    assert got == {1: (rows[0][1], []), 2: ("é end", [(0, len(passage))]), 3: ("", [])}
