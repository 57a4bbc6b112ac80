"""The operators against brute force on small fixtures, with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionquarry.llm import exact_dedup, jaccard, langid, mixing, packing, simhash, substring, token_output, tokens, topk, toxicity, warc
from ionquarry.operators.components import components

BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, __o string, node long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, long texts, copies, near copies, and a column with a clashing name."""
    rng = np.random.default_rng(5)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 300, 40)]
    shared = sentence(rng, 70)
    texts = base + [base[3], base[3] + " ", f"  {base[3]}\n", base[5].replace(" ", "\t")]
    texts += [f"{sentence(rng, 30)} {shared} {sentence(rng, 20)}" for _ in range(6)]
    texts += [None, "", " \n", "Iß", "é", "日本 語", sentence(rng, 20_000), base[7][:-3], "A b C", "a B c", shared, shared]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "o", 5) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[3], None, "s1", 1, "y", None, None), (None, "unique words here", None, "s2", 1, "y", "o", 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def rows(docs):
    return collected(docs)


def test_exact_classes(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(BLANK.sub("", r["text"] or ""), []).append(r)
    want = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        want += [(r["doc_id"], keep, len(own), r["doc_id"] == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in own]
    got = [tuple(r)[:5] for r in exact_dedup.classes(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = collected(exact_dedup.dedup(docs))
    assert len(kept) == len(groups) and set(kept[0]) == set(rows[0])
    assert {BLANK.sub("", r["text"] or "") for r in kept} == set(groups)


def test_exact_group_across_buckets(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.classes(many).where("doc_id < 2500").agg(F.min("group_size"), F.max("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (2500, 2500, 0, 1)
    assert exact_dedup.dedup(many).count() == 501


def brute_fingerprint(text, k):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", "W", "日"]), max_size=400), st.sampled_from([3, 5]))
def test_fingerprint(parts, k):
    assert simhash.fingerprint(" ".join(parts), k) == brute_fingerprint(" ".join(parts), k)


def brute_components(fps, ids, threshold=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_classes(docs, rows):
    fps = [brute_fingerprint(r["text"], 3) for r in rows]
    comps = brute_components(fps, [r["doc_id"] for r in rows])
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(docs).collect()]
    assert sorted(got, key=repr) == sorted([(r["doc_id"], f, c) for r, f, c in zip(rows, fps, comps, strict=True)], key=repr)
    kept = collected(simhash.near_dedup(docs, words=3))
    ids = {c for c in comps if c is not None}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == ids


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e, f = (sentence(rng, 60, 5000) for _ in range(6))
    rows = [(4, a), (None, a), (None, b), (None, c), (None, c), (6, d), (6, d), (6, e), (3, e), (8, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.near_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted([(4, a), (None, b), (None, c), (6, d), (3, e), (8, f)], key=repr)


@pytest.mark.parametrize(("many", "block"), [(jaccard.MANY, jaccard.BLOCK), (-1, 7)])
def test_near_dedup_finds_similarity_of_four_fifths(spark, many, block, monkeypatch):
    monkeypatch.setattr(jaccard.linked, "__defaults__", (many,))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(9)
    passage, texts = sentence(rng, 120, 5000), []
    for n in range(30):
        base = f"{sentence(rng, 100, 5000)} {passage} {sentence(rng, 60, 5000)}".split()
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 9):
            new = list(base)
            for at in rng.choice(280, changes, replace=False):
                new[at] = f"new{n}"
            texts.append(" ".join(new))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root] if root[j] < root[i] else [root[i] if x == root[j] else x for x in root]
    assert 30 <= len(set(root)) < 70
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == sorted(set(root))


@pytest.mark.parametrize("hot", [simhash.HOT, 40, 0])
def test_anchor_links_lose_nothing(spark, hot):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for c in centres for _ in range(12)]
    fps = np.unique(np.array([*centres, *near], dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    signed = fps.view(np.int64).tolist()
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.links(df, hot).collect()
    assert {tuple(r) for r in got} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(50, 51)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(1, 30), 0), 51: 50}


def brute_removed(rows, window=50):
    first = {}
    order = lambda r: 1 << 62 if r["doc_id"] is None else r["doc_id"]
    for r in rows:
        ws = words(r["text"])
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            first[key] = min(first.get(key, order(r)), order(r))
    out = []
    for r in rows:
        ws = words(r["text"])
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < order(r):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((r["doc_id"], len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring(docs, rows):
    want = brute_removed(rows)
    got = [tuple(r)[:4] for r in substring.removed(docs).collect()]
    assert sorted(got, key=repr) == sorted([w[:4] for w in want], key=repr)
    cut = [(r.doc_id, " ".join(words(r.text))) for r in substring.dedup(docs).collect()]
    assert sorted(cut, key=repr) == sorted([(w[0], w[4]) for w in want], key=repr)
    assert substring.dedup(docs).columns == docs.columns


def test_substring_texts_that_share_an_id(spark):
    rng = np.random.default_rng(12)
    passage, other = sentence(rng, 80, 5000), sentence(rng, 60, 5000)
    new = lambda n: sentence(rng, n, 5000)
    texts = [(1, passage), (2, f"{new(200)} {other}")]
    texts += [(i, f"{new(a)} {passage} {new(b)}") for i, a, b in [(None, 7, 3), (None, 300, 40), (9, 5, 2), (9, 150, 90)]]
    texts += [(None, f"{other} {new(30)}"), (9, new(120)), (None, new(90))]
    rows = [{"doc_id": i, "text": t} for i, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = [w[:4] for w in brute_removed(rows)]
    assert sum(w[2] for w in want) == 4 * 80 + 60
    assert sorted((tuple(r)[:4] for r in substring.removed(docs).collect()), key=repr) == sorted(want, key=repr)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\tab.é1' 　\x1c\x85日<|>")), max_size=25), min_size=1, max_size=8))
def test_encoder_equals_library(texts):
    code = tokens.encoder(tokens.TOKENIZER)
    want = [np.array(e.ids, dtype=code.dtype).tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert code.encode(texts) == want


def test_encoder_with_a_small_memo():
    code = tokens.Encoder(bound=50)
    texts = [f"word{i} other{i} same " * 3 for i in range(200)] + [None, ""]
    want = [code.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == want


def test_encoder_of_another_vocabulary():
    code = tokens.Encoder("word_bpe_49k.json")
    texts = ["Two  spaces, and\tTABS ", " Iß it's", None, "e\u0301 \u00a0x"]
    assert not code.cuts and tokens.encoder(tokens.TOKENIZER).cuts
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == [code.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(docs, rows, tmp_path):
    data = token_output.write(docs, f"file://{tmp_path}", sequence=64)
    code = tokens.encoder(tokens.TOKENIZER)
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_output.read(data).collect())
    at, want = 0, []
    for r in order:
        ids = code.library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((at, r["doc_id"], len(ids), ids))
        at += len(ids)
    assert got == want
    shard = data.manifest.orderBy("shard").first()
    reader = token_output.Shard(shard.path)
    ids, mask = reader.sequence_at(shard.n_sequences - 1)
    assert len(ids) == 64 and mask.sum() == shard.n_tokens - 64 * (shard.n_sequences - 1)
    stored = np.concatenate([b.column("attention_mask").flatten().to_numpy(zero_copy_only=False) for b in map(reader.file.get_batch, range(reader.file.num_record_batches))])
    for i in range(shard.n_sequences):
        views = reader.sequence_at(i)
        assert all(not v.flags.owndata and not v.flags.writeable and len(v) == 64 for v in views)
        assert (views[1] == stored[64 * i : 64 * (i + 1)]).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 400), max_size=15), st.sampled_from([1, 4, 16]))
def test_packing_plan(counts, fill):
    plan = packing.Plan(counts, 64, fill)
    used = {}
    for length, n in counts.items():
        for rank in range(n):
            pieces = plan.pieces(length, rank)
            assert sum(p[1] for p in pieces) == length and [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces[:-1]]]).tolist()
            for _, m, seq, offset in pieces:
                used.setdefault(seq, []).append((offset, m))
    assert set(used) == set(range(plan.sequences))
    for spans in used.values():
        at = 0
        for offset, m in sorted(spans):
            assert offset == at
            at += m
        assert at <= 64


def test_packing(docs, rows):
    code = tokens.encoder(tokens.TOKENIZER)
    got = collected(packing.pack(docs, sequence=128))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append(len(code.library.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    assert {k: sum(p["length"] for p in v) for k, v in by_doc.items()} == {k: sum(v) for k, v in want.items()}
    one = sorted(by_doc[20], key=lambda p: p["start"])
    text = next(r["text"] for r in rows if r["doc_id"] == 20)
    assert np.frombuffer(b"".join(p["ids"] for p in one), "<u4").tolist() == [*code.library.encode(text, add_special_tokens=False).ids, 1]
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 128
    assert sum(r["length"] for r in got) / (128 * len(by_sequence)) > 0.98


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    left, out, open_ = budget * sum(sizes.values()), {}, names
    while open_:
        each = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if each * weight[n] > most * sizes[n]]
        out.update({n: most * sizes[n] for n in full} if full else {n: each * weight[n] for n in open_})
        left -= sum(out[n] for n in full)
        open_ = [n for n in open_ if n not in full] if full else []
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 300}, {"a": 0, "b": 10}, {"a": 0, "b": 0}, {None: 7}, {f"s{i}é": (i * 7919) % 101 for i in range(300)}, {"z": 1, "\U0001f600": 50, "\uffff": 60, "": 3}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(n, s - s // 2) for n, s in sizes.items()] + [(n, s // 2) for n, s in sizes.items()], "source string, size long")
    got = {r.name: (r.target, r.source_size, r.n) for r in mixing.sources(rows).collect()}
    want = brute_targets(sizes)
    assert {n: g[1:] for n, g in got.items()} == {n: (s, 2) for n, s in sizes.items()}
    assert all(got[n][0] == pytest.approx(want[n], rel=1e-12) for n in want) and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**62), st.integers(0, 3000), st.floats(0, 1)), max_size=60))
def test_flight_keeps_the_totals(units):
    out = dict(mixing.flight(units))
    assert len(out) == len(units) and sum(p not in (0, 1) for p in out.values()) <= 2
    assert sum(p for p in out.values()) == pytest.approx(sum(p for *_, p in units), abs=1e-4)
    assert sum(units[i][1] * p for i, p in out.items()) == pytest.approx(sum(s * p for _, s, p in units), abs=1e-1)


def test_mixing(spark, docs, rows):
    plan = collected(mixing.plan(docs))
    again = collected(mixing.plan(docs.repartition(5)))
    key = lambda r: (repr(r["doc_id"]), r["size"], repr(r["source"]), r["times"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in plan) == sorted((repr(r["doc_id"]), len(words(r["text"]))) for r in rows)
    sums = {}
    for r in plan:
        assert 0 <= r["times"] <= 2
        sums.setdefault(r["source"], [r["target"], 0])[1] += r["size"] * r["times"]
    # One text of 20 000 words can't be split; a source without it comes within its smallest documents' words.
    largest = {}
    for r in plan:
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(t - k) <= (largest[s] / 2 + 1 if largest[s] > 1000 else 40) for s, (t, k) in sums.items())
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r["times"] for r in plan) and mixed.columns == docs.columns
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("array_join(array_repeat('w', cast(id % 97 + 1 as int)), ' ')").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    got = mixing.plan(big).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("times")).alias("k")).collect()
    assert all(abs(r.t - r.k) <= 2 for r in got)


def test_mixing_of_repeated_rows(spark):
    """A third of the rows have one id and text, a third no id: no chunk grows with them, totals and limits hold."""
    body = F.when(F.col("id") % 3 == 0, "one two three").when(F.col("id") % 3 == 1, F.concat_ws(" ", F.lit("w"), F.col("id").cast("string"))).otherwise(F.expr("array_join(array_repeat('v', cast(id % 50 as int)), ' ')"))
    ident = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 2, F.col("id"))
    docs = spark.range(30_000).select(ident.alias("doc_id"), body.alias("text"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"), F.lit("x").alias("n"), F.lit(1).alias("times"))
    docs = docs.repartition(7)
    plan = collected(mixing.plan(docs))
    sums = {}
    for r in plan:
        assert r["times"] in (0, 1, 2)
        own = sums.setdefault(r["source"], [r["target"], 0, set()])
        own[1] += r["size"] * r["times"]
        if r["doc_id"] == 7:
            own[2].add(r["times"])
    assert len(plan) == 30_000 and all(abs(t - k) <= 2 for t, k, _ in sums.values()) and all(len(x) <= 2 for *_, x in sums.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["times"] for r in plan)


PAGES = "page_id long, url string, html string, sha256 string"


def test_warc(spark, tmp_path):
    big, small = "x" * 1200, "tiny"
    rows = [(1, "http://a/ b", big, ""), (2, "http://a/é", big, ""), (3, None, big + "y", ""), (4, "u\r\nInjected: 1", small, ""), (5, "u", small, ""), (6, "u", None, ""), (7, "u", "é" * 700, ""), (8, "u", "é" * 700, ""), (None, "u", "z" * 1500, ""), (9, "u", "q" * 1000, ""), (9, "u", "q" * 1000, "")]
    pages = spark.createDataFrame(rows, PAGES)
    store = warc.archive(pages)
    assert store.payloads.count() == len({r[2] or "" for r in rows})
    files = warc.write(store, f"file://{tmp_path}")
    back = collected(warc.read(files))
    got = sorted(((r["page_id"], r["size"], r["sha1"], r["type"], r["refers_to"]) for r in collected(warc.resolved(warc.read(files)))), key=repr)
    last = {}
    for r in rows:
        last[r[2]] = max(last.get(r[2], -1), -1 if r[0] is None else r[0])
    want, answered = [], set()
    for p, _, h, _ in rows:
        body = (h or "").encode()
        revisit = len(body) >= 1000 and (-1 if p is None else p) != last[h]
        if p == 9:
            revisit = p in answered
            answered.add(p)
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=repr)
    whole = {r["record_id"]: bytes(r["head"]) + bytes(r["payload"]) for r in collected(warc.reconstruct(store))}
    assert len(whole) == len(rows) and set(whole) == {r["record_id"] for r in back}
    assert all(b"\r\nInjected" not in v.split(b"\r\n\r\n")[0] for v in whole.values())
    text = {r["page_id"]: r["payload"] for r in back if r["type"] == "response"}
    assert bytes(text[8]).decode() == "é" * 700
    assert warc.read(warc.write(warc.archive(pages.where("false")))).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(0, 9))
def test_dual_tree_is_exact(n, dims, seed):
    rng = np.random.default_rng(seed)
    p = rng.integers(-4, 5, (n, dims)).astype(float)
    ids = rng.permutation(n)
    search = topk.Search(p[::5], ids[::5], 7)
    search.add(p, ids)
    for r, (q, own) in enumerate(zip(p[::5], ids[::5], strict=True)):
        s = p @ q
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:7]
        assert search.found[r][: len(order)].tolist() == ids[order].tolist()
        assert search.scores[r][: len(order)].tolist() == s[order].tolist()


def test_dual_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (20, 8)) * 10.0
    p = np.concatenate([c + rng.integers(-2, 3, (200, 8)) for c in centres])
    scored = []
    search = topk.Search(p[:200], np.arange(200), 5)
    original = search._score
    search._score = lambda a, b: (scored.append(len(a.ids) * len(b.ids)), original(a, b))
    search.add(p, np.arange(len(p)))
    assert sum(scored) < 0.5 * 200 * len(p)


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3], 1) for i in range(120)]
    rows += [(340, rows[5][1], 1), (340, rows[6][1], 1), (340, rows[6][1], 1)]  # queries of one id with different vectors
    rows += [(200, None, 1), (220, [float("nan")] * 8, 1), (240, [float("inf")] * 8, 1), (None, rows[0][1], 1), (260, [1.0, None], 1), (300, rows[0][1], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    usable = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        asks = {tuple(v) for i, v in usable if i == q}
        best = sorted((-int(np.array(v) @ w), i) for v in asks for i, w in usable if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(df.where("false"), F.lit(True)).count() == 0 and topk.search(df, F.lit(False)).count() == 0


def test_topk_prunes_cells_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 40)
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(12, 6)) * 40
    rows = [(i, [float(x) for x in (middles[i % 12] + rng.normal(size=6) / 50 if i % 3 else middles[0])]) for i in range(1500)]
    rows += [(9000 + i, [1.0] * (i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(64 * np.array(x)) for i, x in rows}
    told = {}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, 5, report=told).collect()}
    want = {}
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ w), i) for i, w in v.items() if i != q and len(w) == len(v[q]))[:5]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want and told["kept"] < 0.5 * told["pairs"]


@pytest.mark.parametrize("size", [3e6, 1e7, 1e8])
def test_topk_of_large_components_is_exact(spark, size):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=8) * size]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()}
    for q in range(0, 200, 20):
        cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        best = sorted((-cut(sum(a * b for a, b in zip(v[q], w))), i) for i, w in v.items() if i != q)[:20]
        assert [got[q, n] for n in range(1, 21)] == [(i, -s) for s, i in best]


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = sentence(rng, int(rng.integers(5, 80)), 60)
        rows.append((i, f"{text} vile {text}" if bad else text))
        if i < 500:
            labels.append((i, int(bad)))
    rows += [(None, None), (1000, ""), (1001, " \n"), (1002, "vile " * 30_000), (3, rows[3][1])]
    labels += [(2000, 1), (7, None), (8, 5), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 < len(model.at) < 2000
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    held = [(d % 5 == 0) == bool(p) for d, _, p in got if d is not None and 500 <= d < 600]
    assert sum(held) / len(held) > 0.97
    clean = toxicity.clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 - p for *_, p in got)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_fold_is_crc32(spark):
    df = spark.range(50).select("id", toxicity.fold(F.col("id"), 5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())


def test_language_id(spark):
    rng = np.random.default_rng(6)
    vocabulary = {"en": ["the", "and", "with", "shall", "thing"], "de": ["der", "und", "nicht", "über", "schön"], "fr": ["être", "le", "avec", "où", "chose"]}
    rows = [(i, " ".join(rng.choice(vocabulary[n], 30)), n) for i, n in enumerate(list(vocabulary) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 120"))
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 34 !?", None), (903, "语言", None), (904, "the " * 50_000, None), (905, "É", None)], docs.schema)
    got = {r.doc_id: r for r in langid.predict(docs.unionByName(odd), model).collect()}
    assert all(got[i].lang_pred == n for i, _, n in rows if i >= 120)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in vocabulary and got[904].lang_pred == "en" and got[905].lang_pred in vocabulary
    assert all(0 <= r.score <= 1 for r in got.values())
    strict = langid.fit(docs, reject=0.2)
    assert langid.predict(odd.where("doc_id = 903"), strict).first().lang_pred == "und"
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


@pytest.mark.parametrize(
    "run",
    [exact_dedup.classes, exact_dedup.dedup, simhash.classes, simhash.near_dedup, substring.removed, substring.dedup, mixing.plan, mixing.mix, packing.pack, lambda d: token_output.read(token_output.write(d))],
)
def test_empty_tables(docs, run):
    assert run(docs.where("false")).count() == 0
