"""Near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewell.llm import components, decontaminate, minhash, repeats

WORDS = [f"w{i}" for i in range(60)]


def near_brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            k = len(x & y)
            if k and 100 * k >= percent * (len(x) + len(y) - k):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def near_rows(seed, n=120):
    rnd = random.Random(seed)
    bases = [[rnd.choice(WORDS) for _ in range(rnd.randint(1, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i * 3 % 1000, rnd.choice([" ", "\n", "  "]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows + [(2001, None), (2002, ""), (2003, " \t "), (2004, "one two"), (2005, "ONE two"), (2006, "one two three four five")]


@pytest.mark.parametrize("seed,few,leaders,work", [(1, None, 3, None), (2, 0, 1, None), (3, 0, 0, None), (4, None, 1, 30), (5, None, 1, 0)])
def test_near_duplicates(docs, monkeypatch, seed, few, leaders, work):
    """Also by the ways that only hard inputs take: further leaders, and the prefix filter for some buckets or all, in blocks."""
    if few is not None:
        monkeypatch.setattr(minhash, "FEW", few)
    if work is not None:
        monkeypatch.setattr(minhash, "BUCKET_WORK", work)
        monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = near_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(rows, "rep", "component", "key"), leaders=max(leaders, 1)).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_edges(spark, docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    only = minhash.near_duplicates(docs([(1, None), (None, "a b c d e f"), (None, "a b c d e f"), (5, "x " * 30000)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in only) == [(0, 0, True), (0, 0, True), (1, 1, True), (5, 5, True)]
    twice = minhash.near_duplicates(docs([(7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in twice) == [(7, 7, True), (7, 7, True), (9, 7, False)]


def test_min_max_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    s = minhash.signatures([np.unique(a), np.unique(b)], 400)
    assert abs((s[0] == s[1]).mean() - 600 / 1400) < 0.06


def test_bitmap_bound_never_drops(spark, docs):
    """The bitmap filter lets every pair through that meets the threshold."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in near_rows(5, 60) if t and t.strip()]
    texts = docs(rows).select(F.col("doc_id").alias("id"), "text")
    bits = minhash.bitmaps(texts)
    n = minhash.sketch(docs(rows), "doc_id", "text").select("id", F.col("n_shingles").alias("n"))
    x, y = (bits.join(n, "id").alias(k) for k in "xy")
    kept = {(r.a, r.b) for r in x.crossJoin(y).filter(minhash.may_reach(F.col("x.n"), F.col("y.n"), 75)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    sets = {i: set(map(tuple, zip(*[t.encode().lower().split()[k:] for k in range(5)]))) or {tuple(t.encode().lower().split())} for i, t in rows}
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                assert (a, b) in kept


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 60: 50}
    assert components.connected_components(links.filter("false")).count() == 0


def repeat_brute(rows, size):
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for j in range(len(b) - size + 1):
            first.setdefault(b[j : j + size], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if i is not None and first[b[j : j + size]] < i:
                gone[j : j + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,hot", [(0, None), (1, None), (2, None), (3, None), (0, 1), (1, 2), (3, 1)])
def test_repeats(docs, monkeypatch, seed, hot):
    """Also with all minima that occur in so many parts split."""
    if hot:
        monkeypatch.setattr(repeats, "HOT_PARTS", hot)
        monkeypatch.setattr(repeats, "HOT_KINDS", hot)
    monkeypatch.setattr(repeats, "PART_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é"
    parts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(20, 200))) for _ in range(8)] + ["a" * 300, "", "xyz" * 40]
    rows = [(rnd.choice([None, i, 3]) if seed == 3 else i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) if rnd.random() < 0.9 else None) for i in range(60)]
    got = repeats.repeated_spans(docs(rows, "part", "id", "b_text"), min_bytes=50).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == repeat_brute(rows, 50)


def test_repeats_split_a_stock_phrase(spark, docs, monkeypatch):
    """A phrase below the length, and one above it, in texts that differ around them: the same rows, and no large group of fragments."""
    rnd = random.Random(2)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long = say(45), say(64)
    rows = [(i, say(40) + (short if i % 2 else long) + say(rnd.randint(30, 60))) for i in range(400)]
    monkeypatch.setattr(repeats, "PART_BYTES", 1500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(repeats, "HOT_PARTS", 8)
    monkeypatch.setattr(repeats, "HOT_KINDS", 6)
    # The largest number of different fragments sorted together, from what each call notes down.
    note = f"{spark.conf.get('spark.checkpoint.dir')[7:]}/groups"
    plain = repeats.fragment_repeats

    def watched(data, ends, group, doc, least=50):
        with open(note, "a") as f:
            f.write(f"{np.bincount(group).max()}\n")
        return plain(data, ends, group, doc, least)

    monkeypatch.setattr(repeats, "fragment_repeats", watched)
    want, most = repeat_brute(rows, 50), []
    for parts in (8, 1 << 30):
        monkeypatch.setattr(repeats, "HOT_PARTS", parts)
        got = repeats.repeated_spans(docs(rows)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
        with open(note) as f:
            most.append(max(map(int, f)))
        open(note, "w").close()
    assert most[0] < 100 < 150 < most[1], most


def test_repeats_edges(docs):
    assert repeats.repeated_spans(docs([])).count() == 0
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_200_000))
    got = {r.doc_id: (r.n_removed, [(s.start, s.end) for s in r.spans]) for r in repeats.repeated_spans(docs([(1, long[500_000:600_000]), (2, long)])).collect()}
    assert got == {1: (0, []), 2: (100_000, [(500_000, 600_000)])}


def test_maximal_repeats_by_hand():
    """Suffixes of three fragments: the tree of common prefixes and the bytes before them."""
    text = [b"xabcabc", b"yabcabd", b"zabcabc"]
    data, ends = np.frombuffer(b"".join(text), np.uint8), np.array([0, 7, 14, 21])
    frag, offset, length, small = repeats.fragment_repeats(data, ends, np.zeros(3, int), np.array([5, 2, 9]), least=4)
    assert {(f, o, n, s) for f, o, n, s in zip(frag, offset, length, small)} == {(0, 1, 6, 5), (2, 1, 6, 5), (0, 1, 5, 2), (1, 1, 5, 2), (2, 1, 5, 2)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def hits_brute(rows, items):
    items = [(i, WORD.findall(low(t))) for i, t in items if i is not None]
    out = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        cover, found = set(), set()
        for item, x in items:
            k = min(13, len(x))
            wins = {tuple(x[j : j + k]) for j in range(max(1, len(x) - 12))} if x else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    cover.update(range(j, j + k))
                    found.add(str(item))
        n = len(cover)
        out[i] = (len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out


@pytest.mark.parametrize("block", [None, 200])
def test_decontamination(spark, docs, block):
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(["a", "B", "c", "É1", "zz"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([0, 1, 2, 12, 13, 14, 30])] + [(7, None), (None, "lost words")]
    rows = [(i, None if i == 3 else say(rnd.randint(0, 60)) + "." + items[rnd.randrange(7)][1]) for i in range(60)] + [(90, ""), (91, "fern " * 9000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = {"block_bytes": block} if block else {}
    got = decontaminate.contamination(docs(rows, "item_id", "n_hit"), bench, **more).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == hits_brute(rows, items)


def test_decontamination_of_passages_in_many_items(spark, docs):
    """One passage in many items and documents: windows are listed once, items in full; by one block and by several."""
    rnd = random.Random(9)
    say = lambda n: " ".join(f"v{rnd.randrange(900)}" for _ in range(n))
    passage = say(40)
    items = [(i, say(rnd.randint(0, 9)) + " " + passage + " " + say(rnd.randint(0, 9))) for i in range(60)] + [(99, "v1")]
    rows = [(i, say(30) + " " + (passage if i % 3 else say(5)) + " " + say(8)) for i in range(40)] + [(None, None), (50, None), (50, say(20)), (51, passage), (51, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *hits_brute([(i, t)], items)[i]) for i, t in rows)
    for more in ({}, {"block_bytes": 900}):
        found = decontaminate.contamination(docs(rows, "row", "spans", "c0", "contaminated"), bench, carry=("row", "c0", "text"), **more)
        assert found.columns == ["doc_id", "text", "row", "c0", *decontaminate.OUTPUTS]
        assert sorted((str(r[0]), *r[4:7], r[8], r[9]) for r in found.collect()) == want
    some = decontaminate.matches(docs([(1, passage)]), bench).collect()
    assert sorted((r.item_id, r.n_words >= 40) for r in some if r.item_id != "99") == sorted((str(i), True) for i in range(60))
    assert {tuple(r) for r in some} == {tuple(r) for r in decontaminate.matches(docs([(1, passage)]), bench, block_bytes=900).collect()}


def test_decontamination_edges(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")
    assert decontaminate.contamination(docs([]), bench).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(docs([(1, "a b")]), bench.filter("false")).collect()] == [0]
    text = "x y " + " ".join(f"B{i}" for i in range(2, 18)) + " z"
    m = decontaminate.matches(docs([(1, text)]), bench).collect()
    assert [(r.item_id, r.doc_start, r.item_start, r.n_words) for r in m] == [("1", 2, 2, 16)]
