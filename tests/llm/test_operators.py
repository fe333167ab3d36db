"""The dealt operators over every edge case, against brute force, SQL or a round trip."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import oracle
from dermotrace import llm
from dermotrace.llm import cotraining, decontaminate, exact_dedup, license_scan, packing, simhash, suffix_dedup, token_output, tokens
from dermotrace.llm import common, components


def order(d):
    return (d is None, d or 0)


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokens.tokenizer_spec(None))


@pytest.mark.parametrize("name", sorted(llm.MODULES) + ["pipeline"])
def test_empty_tables(spark, empty, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_url_filter", "op6_exact_dedup"])
def test_sql(spark, world, name):
    oracle.same(llm.queries()[name](spark, world[0]), llm.oracle_sql()[name], world[0])


def brute_repeats(docs, length):
    rows = sorted(range(len(docs)), key=lambda i: order(docs[i][0]))
    seen, out = set(), []
    for i in rows:
        b = (docs[i][1] or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if (k := b[p : p + length]) in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(k)
        kept = bytes(c for c, v in zip(b, covered) if not v)
        spans = len(re.findall(b"\1+", bytes(covered)))
        out.append((str(docs[i][0]), len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark, world):
    got = llm.queries()["op1_suffix_dedup"](spark, world[0])
    assert Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(world[1], 100)


def test_suffix_dedup_over_boundaries(spark):
    """So many buckets that equal strings lie in different ones."""
    rows = [(i, "abcdefghij" * 12 + str(i % 3) * (i % 40) + "klmnopqrst" * 11) for i in range(120)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 100)
    text = dict(rows)
    for r in got:
        b = text[r.doc_id].encode()
        assert bytes(r.kept) == b"".join(b[x:y] for x, y in zip([0, *(s.end for s in r.removed)], [*(s.start for s in r.removed), len(b)]))


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words, tie = rng.integers(0, 3, (5000, 4)).astype(np.uint64), rng.permutation(5000)
    by = suffix_dedup.multikey_quicksort(words, [tie])
    rows = [(*w, t) for w, t in zip(words.tolist(), tie.tolist())]
    assert [rows[i] for i in by] == sorted(rows)


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    """Words of the text that lie in a window of an item."""
    w, hit = brute_words(text), set()
    for item in items:
        x = brute_words(item)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            hit |= {k for at in range(len(w) - n + 1) if w[at : at + n] == x[i : i + n] for k in range(at, at + n)}
    return hit


def test_decontaminate_brute_force(spark):
    """Few words, so that windows overlap, repeat and share blocks; items of every length around a block and a window."""
    rng = np.random.default_rng(11)
    make = lambda n: " ".join(rng.choice(["Aa", "b", "é", "0"], n))
    items = [(i, make(n)) for i, n in enumerate([1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 9, 10, 10, 11, 12, 14, 15, 16, 19, 20, 21, 40])]
    for least in (1, 9, 10):
        used = [x for x in items if len(x[1].split()) >= least]
        docs = [(i, make(int(rng.integers(0, 60))) if i % 3 else f"{make(7)}, {used[i % len(used)][1]} - {make(5)}") for i in range(80)]
        got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(used, "item_id long, text string"))
        for r in got.collect():
            hit = brute_hits(docs[r.doc_id][1], [t for _, t in used])
            assert (r.n_words, r.n_hit) == (len(brute_words(docs[r.doc_id][1])), len(hit))
            assert r["items"] == sorted(str(i) for i, t in used if brute_hits(docs[r.doc_id][1], [t]))
            assert sum(len(brute_words(docs[r.doc_id][1][s.start : s.end])) for s in r.spans) == len(hit)


def test_decontaminate_blocks(spark, world):
    """Many small automata find what one finds; spans are places in the original text."""
    docs, bench = spark.read.parquet(f"{world[0]}/documents.parquet"), spark.read.parquet(f"{world[0]}/benchmark.parquet")
    one, many = (sorted(map(str, decontaminate.decontaminate(docs, bench, n).collect())) for n in (1 << 20, 300))
    assert one == many
    text = {d[0]: d[1] for d in world[1]}
    for r in decontaminate.decontaminate(docs, bench).where("n_hit > 0 and doc_id != 204").collect():
        for s in r.spans:
            assert decontaminate.words(text[r.doc_id][s.start : s.end])


def test_tokens(library, world):
    enc = tokens.Encoder(tokens.tokenizer_spec(None), memo=50)
    texts = [d[1] or "" for d in world[1]] + ["a  b\n\n c\t d", " lead", "trail ", "\n", "don't we'll", "x\x1c y", "é.\nÉ à la  carte"]
    import pyarrow as pa

    for text, ids in zip(texts, enc.encode_many(pa.array(texts)), strict=True):
        assert ids.tolist() == np.frombuffer(enc.encode(text), f"<u{enc.width}").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_shards(spark, world, library):
    got = llm.queries()["op4_token_shards"](spark, world[0]).orderBy("start").collect()
    want = Counter()
    for d in world[1]:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids + [2]
        want[d[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_token_lookup(spark, world, library):
    docs = spark.read.parquet(f"{world[0]}/documents.parquet")
    manifest = token_output.write_shards(docs, common.scratch(spark, "t"), shards=3)
    wanted = [(0,), (7,), (204,), (-5,), (9999,), (None,)]
    got = token_output.lookup(manifest, spark.createDataFrame(wanted, "doc_id long")).collect()
    text = defaultdict(list)
    for d in world[1]:
        text[d[0]].append(library.encode(d[1] or "", add_special_tokens=False).ids + [2])
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((i, x) for (i,) in wanted if i is not None for x in text.get(i, []))


def test_exact_blocks(spark):
    """Tiny blocks make deep recursion; texts that differ in one place stay apart."""
    texts = ["a" * n for n in (0, 1, 7, 8, 9, 64, 65)] * 2 + ["a" * 64 + "b", "a" * 63 + "ba", "a" * 65] + [None, " "]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()
    plain = {i: (t or "").replace(" ", "") for i, t in enumerate(texts)}
    for r in got:
        assert r.group_size == sum(plain[r.doc_id] == p for p in plain.values())
        assert plain[r.keep_id] == plain[r.doc_id]
    assert sum(r.kept for r in got) == len(set(plain.values()))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, world):
    docs = world[1]
    fp = [brute_fingerprint(d[1]) for d in docs]
    group = list(range(len(docs)))
    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    name = defaultdict(lambda: None)
    for i, d in enumerate(docs):
        r = root(i)
        name[r] = min((x for x in (name[r], d[0]) if x is not None), default=None)
    want = Counter((str(d[0]), f"{fp[i]:016x}", str(name[root(i)])) for i, d in enumerate(docs))
    got = llm.queries()["op7_simhash"](spark, world[0]).collect()
    assert Counter((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_links(spark):
    """Every pair within four bits is joined, however the bits lie."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60, np.int64)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 4, 5)]
    values = [x - (1 << 64) if x >> 63 else x for x in {*base, *near}]
    made = components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    root = {r.node: r.root for r in made}
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert root[a] == root[b]
    graph = defaultdict(set)
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                graph[a].add(b)
                graph[b].add(a)
    assert set(root) == set(graph)


def test_licenses(spark, world):
    got = {r.doc_id: r for r in llm.queries()["op8_license_scan"](spark, world[0]).collect()}
    assert got[211].licenses == "Apache-2.0,MIT" and got[211].n_hits == 2
    assert got[200].licenses == got[201].licenses == got[3].licenses == ""
    assert len(got) == len({d[0] for d in world[1]})


def test_license_alignment():
    ready, triggers = license_scan._prepared(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES:
        noisy = " ".join(w if i % 9 != 4 else "" for i, w in enumerate(text.split()))
        for body in (text, text.upper(), text.replace(" ", "\n * "), f"{'word ' * 300}{text} tail", f"{text}\n{text}"):
            hits = license_scan.scan(body, ready, triggers)
            assert hits and all(h["license"] == name for h in hits), (name, hits)
            assert len(hits) == (2 if body.startswith(f"{text}\n{text[:9]}") and body.count(text) == 2 else 1)
            assert body[hits[0]["start"] : hits[0]["end"]].lower().split()[0].strip('"') in text.lower()
        if len(text.split()) > 12:
            assert license_scan.scan(noisy, ready, triggers)
    assert license_scan.scan("the license of this work is version 3", ready, triggers) == []
    pairs = license_scan.align("a b x c d e f".split(), "a b c d q e f".split())
    assert [p for p in pairs] == sorted(pairs) and len(pairs) == 6


def test_languages(spark, world):
    got = llm.queries()["op9_language_id"](spark, world[0]).collect()
    lang = {d[0]: (d[2], d[1]) for d in world[1]}
    assert len(got) == len(world[1])
    long = [r for r in got if r.doc_id is not None and 0 <= r.doc_id < 100 and len(lang[r.doc_id][1]) > 200]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in long) >= 0.95 * len(long)
    none = {r.doc_id: r for r in got}
    assert all(none[i].lang_pred == "und" and none[i].score == 0 for i in (200, 201, 202, 203))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_language_held_out(spark):
    """Held-out accuracy on the given documents."""
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in llm.queries()["op9_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)


def test_cotraining(spark, world):
    got = llm.queries()["op5_cotraining"](spark, world[0]).collect()
    assert len(got) == len(world[1]) and all(0 <= r.score <= 1 for r in got)
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in llm.queries()["op5_cotraining"](spark, sf).collect() if r.doc_id in label]
    assert sum((r.score >= 0.5) == (label[r.doc_id] == 1) for r in got) >= 0.97 * len(got)


def test_cotraining_views():
    """The pool teaches: with few labels the second view learns from the first one's confident calls."""
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 2000)
    views = [(truth[:, None] * 2 - 1) * 2 + rng.normal(size=(2000, 3)), (truth[:, None] * 2 - 1) + rng.normal(size=(2000, 5))]
    views = [v.astype(np.float32) for v in views]
    y = np.where(np.arange(2000) < 40, truth, -1)
    model = cotraining.cotrain(views, y, np.arange(2000) % 5)
    assert ((cotraining.score(*views, model)[2] >= 0.5) == truth).mean() > 0.97
    assert cotraining.cotrain(views, np.full(2000, -1), np.arange(2000) % 5) == {"constant": 0.5}


def test_packing(spark, world, library):
    got = llm.queries()["op10_packing"](spark, world[0]).collect()
    ids = defaultdict(list)
    for d in world[1]:
        ids[d[0]].append(library.encode(d[1] or "", add_special_tokens=False).ids + [1])
    sequences, covered = defaultdict(list), Counter()
    of = {d[0]: Counter() for d in world[1]}
    for r in got:
        of[r.doc_id][r.start, r.length, r.doc_tokens, r.ids_crc32] += 1
    for d, pieces in of.items():
        # rows of a doc_id are told apart by taking their pieces off: each id of each row lies in exactly one piece
        for x in sorted(ids[d], key=len):
            at = 0
            while at < len(x):
                p = next(p for p in pieces if pieces[p] and p[0] == at and p[2] == len(x) and zlib.crc32(np.array(x[at : at + p[1]], "<u4").tobytes()) == p[3])
                pieces[p] -= 1
                at += p[1]
            assert at == len(x)
        assert not +pieces
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert covered == {d: sum(map(len, x)) for d, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at & (at - 1) == 0 and at <= 2048


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 400).tolist()
    bins, free, want = packing.first_fit_decreasing(sizes, 100), [], []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(100)
            want.append([])
        free[k] -= sizes[i]
        want[k].append(i)
    assert bins == want
    assert packing.first_fit_decreasing([], 8) == [] and packing.fill([], []) == []


def test_pipeline(spark, world):
    """Each stage held against a plain version of itself on what the one before kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{world[0]}/documents.parquet").select(*p.COLUMNS)
    folder = common.scratch(spark, "stages")
    kept = [docs]
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, kept[-1], world[0]).write.parquet(f"{folder}/{i}")
        kept.append(spark.read.parquet(f"{folder}/{i}"))
        assert kept[-1].columns == list(p.COLUMNS)
    texts = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    letters = [x for x in texts[0] if x[1] and re.search(r"[^\W\d_]", x[1])]
    assert set(texts[1]) <= set(letters) and len(texts[1]) >= len(letters) - 3
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert Counter(plain(t) for _, t in texts[2]) == Counter({plain(t) for _, t in texts[1]})
    near = [brute_fingerprint(t) for _, t in texts[3]]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(near) for b in near[:i])
    bench = [r.text for r in spark.read.parquet(f"{world[0]}/benchmark.parquet").collect() if r.item_id is not None]
    assert Counter(texts[4]) == Counter(x for x in texts[3] if not brute_hits(x[1], bench))
    last = p.run(spark, world[0])
    assert Counter(r.doc_id for r in last.where("start = 0").select("doc_id").collect()) == Counter(i for i, _ in texts[4])
