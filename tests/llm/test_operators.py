"""Each operator against brute force on whole small tables, and its edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, fertility, hosts, langid, linededup, ngramjoin, packing, quality, queries, toxicity
from trialweave.llm.sharding import Conflict, ShardStore
from trialweave.llm.shared import Scratch, connected_components

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


ODD = [
    (None, "a text without an id that has some words in it"),
    (1, None),
    (2, ""),
    (3, " \t\r\n\x0b\x0c "),
    (4, "one"),
    (5, "One two three"),
    (5, "One two three"),
    (6, "x" * 300_000),
    (7, "same words here again " * 40_000),
    (8, "你好 \U0001f600 é İ straße ΣΣ ²"),
    (9, "<|endoftext|> A<|ENDOFTEXT|>b H̱ <unk> '\"quoted\" it's"),
    (10, "l1 a b c\nl2 d e f\n\nl3 g h i\nl4 j k l"),
    (11, "l0\nl1 a b c\nl2 d e f\nl3 g h i\nl4 j k l\nend"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", 1.0, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_removed string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


# -- op3

def word_set(text, n):
    w = [x for x in re.split(f"[{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(sets, num, den):
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            holders[g].append(i)
    shared = Counter((a, b) for x in holders.values() for k, a in enumerate(x) for b in x[k + 1 :])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_ngram_join_is_brute_force(docs, texts, n, num):
    sets = {i: word_set(t, n) for i, t in texts.items()}
    want = brute_components(sets, num, 100)
    got = ngramjoin.jaccard_components(docs, n=n, num=num, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_ngram_join_near_the_threshold(spark):
    rng = random.Random(3)
    rows, sets = [], {}
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 8, 12, 40, 120, 300]))]
        for copy in range(6):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 20 + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(w)))
    sets = {i: word_set(t, 4) for i, t in rows}
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets, 85, 100)


def test_ngram_join_with_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(words)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 25)
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components({i: word_set(t, 4) for i, t in rows}, 85, 100)


@pytest.mark.parametrize("pivots", [0, 64])
def test_ngram_join_of_large_clusters(spark, monkeypatch, pivots):
    """Chains, and families that meet in buckets without a link, in clusters of several blocks."""
    rng = random.Random(5)
    long = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(long[4 * k : 4 * k + 120])) for k in range(150)]
    for family in range(3):
        base = [f"b{k}" for k in range(200)]
        for cut in range(family * 4):
            base[50 * cut % 200 + family] = f"f{family}-{cut}"
        for copy in range(50):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            rows.append((1000 + 100 * family + copy, " ".join(w)))
    rows += [(5000 + i, rows[i][1]) for i in range(0, 300, 17)]
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 20)
    monkeypatch.setattr(ngramjoin, "PIVOTS", pivots)
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    want = brute_components({i: word_set(t, 4) for i, t in rows}, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 1


def test_ngram_join_with_blocks_of_few_grams(spark, monkeypatch):
    rows = [(i, " ".join([f"w{k}" for k in range(400)] + [f"x{i}-{k}" for k in range(i % 7)])) for i in range(14)]
    monkeypatch.setattr(ngramjoin, "BLOCK_GRAMS", 1000)
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 14


@pytest.mark.parametrize("most", [4096, 12])
def test_ngram_join_keeps_texts_of_a_shared_passage_apart(spark, monkeypatch, most):
    """Unlinked texts that share half of their words: rows sent to trees do not grow faster than the documents."""
    sent = []
    joined = ngramjoin._joined

    def counted(texts, *rest):
        sent.append(texts.count())
        return joined(texts, *rest)

    monkeypatch.setattr(ngramjoin, "_joined", counted)
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 20)
    monkeypatch.setattr(ngramjoin, "BUCKET", most)  # 12: texts meet again under finer keys
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    at = []
    for count in (150, 600):
        rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))) for i in range(count)]
        rows += [(10_000 + i, rows[i][1] + " end") for i in range(0, count, 10)]
        del sent[:]
        got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}
        at.append(sum(sent))
    assert at[0] >= 30 and at[1] <= 5 * at[0] and at[1] <= 600


@pytest.mark.parametrize(("most", "levels"), [(5, 1), (5, 4), (20, 4)])
def test_ngram_join_of_full_buckets(spark, monkeypatch, most, levels):
    """Keys with more rows than are compared: finer keys, and ties without a look at the end, lose nothing."""
    rng = random.Random(9)
    rows = []
    for family in range(2):
        words = [f"w{k}" for k in range(150)] + [f"f{family}-{k}" for k in range(50)]
        for i in range(60):
            w = list(words)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            rows.append((100 * family + i, " ".join(w)))
    want = brute_components({i: word_set(t, 4) for i, t in rows}, 85, 100)
    monkeypatch.setattr(ngramjoin, "BUCKET", most)
    monkeypatch.setattr(ngramjoin, "LEVELS", levels)
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 2 < len(set(want.values())) < 80


def test_sketch_expression(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, (50, 2, ngramjoin.SKETCH // 64 * ngramjoin.PLANES), dtype=np.int64)
    got = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in x], "a array<long>, b array<long>").select(ngramjoin._apart_column(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ngramjoin.apart_codes(x[:, 0].view(np.uint64), x[:, 1].view(np.uint64)).tolist()


def test_sketches_of_linked_sets_are_close():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(200):
        base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
        sets += [np.unique(base[:184]), np.unique(base[16:])]  # similarity 168 / 200
    bands = ngramjoin.bands_for(0.84)
    _, codes = ngramjoin.routing_keys(sets, bands)
    most = ngramjoin.most_apart(0.84, min(ngramjoin.SKETCH, bands * ngramjoin.ROWS))
    assert (ngramjoin.apart_codes(codes[0::2], codes[1::2]) <= most).all()
    assert (ngramjoin.apart_codes(codes[0:-2:2], codes[2::2]) > most).all()
    assert 20 < most < 60


def test_first_of_each_loses_no_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "y"), (None, b + " end", "n"), (None, c, "m"), (None, c, "k"), (None, None, "n"), (None, None, "n"), (7, "", "e"), (7, "", "e"), (9, None, "e"), (3, c + " more", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(3)
    got = ngramjoin.first_of_each(df)
    assert got.columns == df.columns
    want = [(1, a, "x"), (5, b, "y"), (3, c + " more", "c"), (None, None, "n"), (None, None, "n"), (7, "", "e"), (7, "", "e"), (9, None, "e")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    whole = ngramjoin.first_of_each(df.where("_id in ('x', 'z', 'n') and text is not null"))
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(map(repr, [(1, a, "x"), (5, b, "z")]))


def test_ngram_join_odd_rows(odd, empty):
    got = sorted((r["doc_id"] is not None and r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(odd).collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [g for g in got if g[0] == 5] == [(5, 1, 5), (5, 1, 5)]
    assert [g for g in got if g[0] == 7] == [(7, 4, 7)]
    assert len(got) == len(ODD)
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_signature_tree_prunes_only_what_cannot_be():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(150):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(3, 60), dtype=np.uint64))
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], base[:1], rng.integers(0, 1 << 62, rng.integers(0, 3), dtype=np.uint64)])))
    want = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)}, 80, 100)
    got = ngramjoin.SignatureTree(sets, 80, 100).join()
    groups = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == x) for x in set(roots)}
    assert groups(got) == groups([want[i] for i in range(len(sets))])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "roots").collect()}
    assert got == {i: find(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}


# -- op4

def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = words(text)
    at = defaultdict(list)
    for size in {min(13, len(words(t))) for _, t in items}:
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append(i)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        if not x:
            continue
        size = min(13, len(x))
        for i in range(len(x) - size + 1):
            for p in at.get(tuple(x[i : i + size]), ()):
                hit.update(range(p, p + size))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def contaminated(df, bench, **options):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.verdicts(decontaminate.find_contamination(df, bench, **options)).collect()}


def test_decontamination_is_brute_force(spark, sf, docs, texts):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = contaminated(docs, bench)
    assert got == {i: brute_contamination(t, items) for i, t in texts.items()}
    assert any(x[4] for x in got.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination_short_and_repetitive_items(spark, block_bytes):
    rng = random.Random(5)
    vocab = ["a", "b", "C", "dé", "e5"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 60, 0, 4, 13])] + [(50, None), (51, "a a a a a a a a a a a a a a a"), (3, "b b b")]
    rows = [(i, text(rng.randrange(0, 120))) for i in range(60)] + [(100, "a " * 50), (101, None), (102, items[7][1] + " zz " + items[8][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block_bytes)
    assert got == {i: brute_contamination(t, items) for i, t in rows}


def test_decontamination_odd_rows(spark, odd, empty, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(decontaminate.find_contamination(odd, bench).collect()) == len(ODD)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    none = bench.limit(0)
    assert not any(x[4] for x in contaminated(odd, none).values())
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.remove_contaminated(odd, bench).count() == len(ODD)


# -- op5

def brute_line_dedup(rows):
    """Text, pieces, removed pieces; by the pieces alone, character for character."""
    spans = {i: linededup.units(t) for i, t in rows}
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [t[a:b].strip() for a, b in spans[i]]
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if first.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        dead = {x for k in gone for x in range(spans[i][k][0], spans[i][k][1] + t[spans[i][k][1] :].startswith("\n"))}
        out[i] = "".join(c for x, c in enumerate(t) if x not in dead), len(lines), len(gone)
    return out


def test_line_dedup_is_brute_force(docs, texts):
    rows = [(i, t) for i, t in texts.items() if t is not None]
    want = brute_line_dedup(rows)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect()}
    assert {i: got[i] for i in want} == want
    assert sum(x[2] for x in want.values()) > 0


def test_line_dedup_catches_a_long_line():
    passage = " ".join("Word%d of the passage number %d ends here." % (k, k) for k in range(8))
    assert len(linededup.units("x\n" + passage)) == 9
    assert linededup.without("a\nb\nc\nd", [0]) == ("d", 4, 3)
    assert linededup.without("a\n\nb\nc\nd", [1])[0] == "a\n\n"


def test_line_dedup_folds_alike_anywhere():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(2_000)]
    prose = lambda n, end: " ".join(rng.choice(words) + ("." if rng.random() < end else "") for _ in range(n))
    missed, removed, total = 0, 0, 0
    for k in range(200):
        end = (0, 0.03, 0.1)[k % 3]
        passage = prose(rng.randint(51, 80), end)
        here, there = (f"{prose(rng.randint(0, 40), end)} {passage} {prose(30, end)}" for _ in range(2))
        known = set(linededup.window_hashes(here, linededup.units(here)))
        spans = linededup.units(there)
        text, _, gone = linededup.without(there, [i for i, h in enumerate(linededup.window_hashes(there, spans)) if h in known], spans)
        missed += gone == 0
        removed += len(there.split()) - len(text.split())
        total += len(passage.split())
    assert missed <= 4 and 0.75 * total < removed <= total
    many = [prose(rng.randint(0, 90), 0.05) + "\n" * (k % 3) + prose(20, 0) for k in range(40)] + ["", "\n", "a " * 500]
    assert linededup.units_of(many) == [linededup.units(t) for t in many]


def test_line_dedup_folds_what_repeats_over_and_over(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, f"{words(0, 40)} {'the ' * 90}{words(40, 60)}"), (2, f"{words(100, 133)} {'the ' * 70}{words(133, 170)}"), (3, f"{words(200, 230)} {'a b ' * 100}")]
    for _, t in rows:
        pieces = [len(t[a:b].split()) for a, b in linededup.units(t)]
        assert 5 <= min(pieces[:-1]) and max(pieces) <= linededup.MOST_PIECE
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].split().count("the") < 24 and set(words(100, 133).split()[:25]) < set(got[2].split())
    assert got[1].split().count("the") < 60 and got[3].split().count("a") < 60  # all but the first windows of the stretch
    assert linededup.units_of([t for _, t in rows]) == [linededup.units(t) for _, t in rows]


def test_line_dedup_removes_every_repeated_window(spark):
    """Three lines that were there before go, however few words they have; two do not."""
    rows = [(1, "a b\nc\nd e f\nfirst"), (2, "x\na b\nc\nd e f\ny"), (3, "a b\nc\nz"), (4, "q\nc\n\nd e f\na b"), (4, "a b\nc\nd e f\nfirst")]
    got = {r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0][1], "x\ny", rows[2][1], rows[3][1], ""}
    pieces = linededup.units("It was a dark night. It rained. The wind blew. " + " ".join(f"w{k}" for k in range(30)))
    assert len(pieces) > 1 and all(b - a >= 5 for a, b in pieces)


def test_line_dedup_odd_rows(odd, empty):
    out = linededup.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "lang", "score", "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[5]["n_removed"] == 0
    assert got[10]["n_removed"] == 0 and got[11]["text"] == "l0\nend" and got[11]["n_removed"] == 4
    assert out.count() == len(ODD)
    assert linededup.dedup_lines(empty).count() == 0


# -- op6

def test_sharding(spark, odd, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=20_000, fan_in=3)
    for _ in range(4):
        store.append(odd)
    first = store.latest()
    before = store.shards(first)
    assert first.version == 4 and len(first.lists) >= 4 and sum(s.rows for s in before) == 4 * len(ODD)
    merged = store.compact()
    assert merged.version == 5 and len(store.shards(merged)) < len(before)
    assert sum(s.rows for s in store.shards(merged)) == 4 * len(ODD)
    old = store.load(first)
    assert old.count() == 4 * len(ODD)  # earlier versions stay readable
    with pytest.raises(Conflict):
        store.commit(first, [])
    store.vacuum()
    columns = odd.columns
    want, got = Counter(map(tuple, odd.collect() * 4)), Counter(map(tuple, store.load().select(*columns).collect()))
    assert got == want
    assert store.append(odd.limit(0)).version == 6
    assert store.settle().version >= 6 and not store.runs(store.shards())


def test_sharding_lists(spark, tmp_path, monkeypatch):
    """A merge writes anew only the lists of what it replaced; lists of whole shards are not read for it."""
    from trialweave.llm import sharding

    monkeypatch.setattr(sharding, "LIST_SHARDS", 2)
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1_500, fan_in=3)
    store.append(spark.range(6_000).toDF("doc_id").coalesce(1))  # at target size at once
    whole = store.latest().lists[0]
    assert whole.small == 0
    store.append(spark.range(6).toDF("doc_id").repartition(5))
    assert sum(x.shards for x in store.latest().lists) == 1 + len(store.shards(small=True)) and len(store.latest().lists) > 2
    read = []
    monkeypatch.setattr(store, "_read_list", lambda one, f=store._read_list: read.append(one.name) or f(one))
    merged = store.compact()
    assert whole in merged.lists and whole.name not in read and len(store.shards(merged)) == 2
    store.vacuum()
    assert {p.name for p in (tmp_path / "store/lists").iterdir() if not p.name.endswith(".crc")} == {x.name for x in merged.lists}
    assert store.load().count() == 6_006


def test_sharding_two_writers(spark, tmp_path):
    """Of all writers that commit the same version one wins, and its manifest is whole."""
    from concurrent.futures import ThreadPoolExecutor

    store = ShardStore(spark, f"file://{tmp_path}/store")
    base = store.append(spark.range(3).toDF("doc_id"))

    def write(k):
        try:
            return store.commit(base, store.shards(base) * k)
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [m for m in pool.map(write, range(16)) if m]
    assert len(won) == 1 and store.latest() == won[0] and store.versions() == [1, 2]
    assert not [p for p in (tmp_path / "store/manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_sharding_vacuum_spares_what_is_being_written(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", fan_in=2)
    rows = spark.range(6).toDF("doc_id").coalesce(1)
    store.append(rows)
    store.append(rows)
    replaced = {s.path for s in store.shards()}
    rows.write.parquet(f"{store.root}/data/coming")  # another writer before its commit
    store.compact()
    store.vacuum()
    left = {str(p.relative_to(tmp_path / "store")) for p in (tmp_path / "store/data").rglob("*.parquet")}
    assert not left & replaced and any(p.startswith("data/coming") for p in left)
    store.commit(store.latest(), store._written("data/coming", 0)["data/coming"])
    assert store.load().count() == 18
    store.vacuum(grace_s=-60)
    assert store.load().count() == 18


def test_sharding_odd_tables(spark, odd, empty, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        store.load()
    store.vacuum()
    assert [m.version for m in store.append_each(empty, F.lit(0))] == [1]
    store.vacuum()
    none = store.load()
    assert none.count() == 0 and none.columns == ["_shard", *odd.columns, "_rows", "_bytes", "_generation", "_version"]
    clash = odd.withColumns({"_shard": F.lit("x"), "_rows": F.lit("y"), "_arrival0": F.lit("z")})
    store = ShardStore(spark, f"file://{tmp_path}/clash", fan_in=2)
    assert len(store.append_each(clash, F.coalesce(F.col("doc_id") % 2, F.lit(7)))) == 3
    store.settle()
    out = store.load()
    assert out.count() == len(ODD) and {r["_arrival0"] for r in out.collect()} == {"z"}
    assert {tuple(r) for r in store._rows(store.latest(), store.shards()).select("_shard", "_rows").collect()} == {("x", "y")}


def test_sharding_query_without_rows(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_sharding(spark, str(tmp_path)).collect() == []


def test_sharding_query(spark, sf, docs):
    out = queries.op6_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(n == out[[r["shard"] for r in out].index(s)]["shard_rows"] for s, n in Counter(r["shard"] for r in out).items())


# -- words of long texts

def test_words_of_long_texts_are_hashed_in_steps(monkeypatch):
    import tracemalloc

    from trialweave.llm import text

    table = text.byte_table("space")
    texts = [b"", b"one Two\nthree " * 300, b"x" * 5_000, b" \t", b"a b " * 2_000 + b"y" * 900]
    whole = text.Words(texts, table)
    monkeypatch.setattr(text, "SLICE_BYTES", 256)
    monkeypatch.setattr(text, "_powers", {})
    steps = text.Words(texts, table)
    for name in ("start", "end", "hash", "first"):
        assert (getattr(whole, name) == getattr(steps, name)).all()
    monkeypatch.undo()
    long = b"some words of a text that is very long indeed " * 500_000  # 23 MB
    text.Words([b"warm"], table)
    tracemalloc.start()
    words = text.Words([long], table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words.hash) == 5_000_000 and peak < 16 * len(long) + (256 << 20)
    assert all(len(x) <= text.SLICE_BYTES + (1 << 16) for x in text._powers.values())


def test_very_long_texts_go_through_every_operator(spark, sf):
    """Texts of some 4 MB, more than is hashed in a step, alike but for an ending; one without a space."""
    rng = random.Random(10)
    words = [f"w{k}" for k in range(50_000)]
    base = " ".join(rng.choice(words) + ("\n" if k % 9 == 0 else "") for k in range(600_000))
    rows = spark.createDataFrame([(1, base), (2, base + " end"), (3, "z" * 4_000_000), (4, None)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    bench = spark.createDataFrame([(7, " ".join(base.split()[400_000:400_020]))], "item_id long, text string")
    found = contaminated(rows, bench)
    assert found[1][:3] == (600_000, 20, 1) and found[3][:3] == (1, 0, 0)
    rules = {r["doc_id"]: r for r in fertility.quality_rules(rows, queries.PIECES).collect()}
    assert rules[1]["n_words"] == 600_000 and rules[3]["word_chars"] == 4_000_000
    packed = packing.pack_documents(rows, queries.WORD_BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(packed) == 4 and all(r["n"] == r["t"] for r in packed)
    lines = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(rows).collect()}
    assert lines[1] == 0 and lines[2] > 50_000
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = toxicity.score(rows, toxicity.fit_on(docs, labels)).collect()
    good = quality.grade(rows, quality.fit_on(docs, labels.selectExpr("doc_id", "quality as grade"), 2)).collect()
    lang = langid.identify(rows, langid.fit_on(docs)).collect()
    assert [len(x) for x in (bad, good, lang)] == [4, 4, 4] and {r["lang_pred"] for r in lang if r["doc_id"] == 4} == {"und"}


def test_features_of_a_long_text_come_in_steps(monkeypatch):
    from trialweave.llm import grams

    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 5_000, dtype=np.uint8)) + b" end"
    table = rng.normal(size=(langid.GRAMS.width, 2))
    whole = langid.GRAMS.mean_weights([text], table)
    vector = langid.GRAMS.vectors([text])[0]
    for step in (1, 2, 3, 700, 5_003):
        monkeypatch.setattr(grams, "SLICE_BYTES", step)
        assert np.allclose(langid.GRAMS.mean_weights([text], table), whole, atol=1e-12)
        assert all((a == b).all() for a, b in zip(langid.GRAMS.vectors([text])[0], vector))


# -- op7

def brute_rules(text):
    t = text or ""
    w = [x for x in re.split(f"[{SPACE}]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_quality_rules_are_brute_force(spark, docs, odd, empty):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.PIECES)
    for df, count in ((docs, docs.count()), (odd, len(ODD))):
        got = fertility.quality_rules(df, queries.PIECES, carry=("doc_id", "text")).collect()
        assert len(got) == count
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(r["text"])
            assert not (r["base_failed"] and r["kept"])
            if len(r["text"] or "") < 5000:
                assert r["n_tokens"] == sum(len(model.encode(x)) for x in re.split(f"[{SPACE}]+", r["text"] or "") if x)
    assert fertility.quality_rules(empty, queries.PIECES).count() == 0


def test_quality_rules_verdict(spark):
    import string

    good = " ".join("word number %s is a normal one" % string.ascii_letters[k % 52] * 2 for k in range(30))
    noisy = " ".join(f"w{k}%%%## &&" for k in range(80))
    df = spark.createDataFrame([(1, "It is a text of plain English words about nothing in particular, " + " ".join(f"and {a}{b}" for a in ("then", "river", "house", "garden", "window", "bread") for b in ("s", "ly", "ful", "ish", "er", "ing", "al"))), (2, noisy), (3, good)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.quality_rules(df, queries.PIECES).collect()}
    assert kept[1] and not kept[2]


# -- op8

def test_hosts_rules(spark):
    urls = ["http://a.net/x", "http://A.Example.NET/en/1?q", "http://example.net/de/", "https://example.com/de/1", "https://w.example.com/den", "ftp://x.org/fr/z#f", "http://org", "nourl", None, "http://b.net", "http://notexample.net/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([("bad.info", 0)] * 60 + [("good.info", 1)] * 400, "host string, good int")
    more = df.unionByName(spark.createDataFrame([(20, "http://bad.info/1"), (21, "http://good.info/1"), (22, "http://new.info/")], "page_id long, url string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judge(more, bad).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2] is None
    assert got[5] == ("x.org", "/fr/z", "org/fr/", "allow") and got[6][:3] == ("org", "", None)
    assert got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None) and got[9][2] is None and got[10][2] == "net/"
    assert got[20][3] == "block" and got[21][3] == "allow" and got[22][3] == "allow"
    assert hosts.judge(df.limit(0), bad).count() == 0
    assert {r["verdict"] for r in hosts.judge(df, bad.limit(0)).where("rule is null").collect()} == {"allow"}
    # Bad outcomes of pages without a host count for none.
    nowhere = bad.where("host = 'good.info'").unionByName(spark.createDataFrame([("", 0)] * 60 + [(None, 0)], "host string, good int"))
    got = {r["page_id"]: (r["verdict"], r["good_mean"]) for r in hosts.judge(df, nowhere).collect()}
    assert got[7] == got[8] == ("allow", 401 / 402)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# -- op9

def test_packing_is_exact(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.WORD_BPE)
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        if df is docs:
            want = {r["doc_id"]: [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}
        pieces = packing.pack_documents(df, queries.WORD_BPE, with_ids=True).collect()
        load, own = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.array(p["ids"], "<u4")
            assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and len(ids) == p["length"]
            load[p["sequence_id"]].append((p["offset"], p["length"]))
            own[p["doc_id"]].append(p)
        for parts in load.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        if df is docs:
            for i, ids in want.items():
                joined = [x for p in sorted(own[i], key=lambda p: p["start"]) for x in p["ids"]]
                assert joined == ids and {p["doc_tokens"] for p in own[i]} == {len(ids)}
        else:
            for i, t in ODD:
                if i in (1, 2, 3, 4, 8, 9):
                    assert [x for p in sorted(own[i], key=lambda p: p["start"]) for x in p["ids"]] == [*model.encode(t or "", add_special_tokens=False).ids, 1]
    assert packing.pack_documents(empty, queries.WORD_BPE).count() == 0


def test_packing_wastes_little(spark):
    rng = random.Random(0)
    for sizes in ([rng.randrange(1, 513) for _ in range(700)], [512] * 401, [1] * 5000, [300, 300], [2048, 1]):
        bins = packing.pack_group(sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= 1 + -(-sum(sizes) // 2048) * 1.02
    assert packing.difference([8, 7, 6, 5, 4], 2)[0] == 16  # differencing, not first fit


# -- op2, op10, op1

def test_automaton_is_edit_distance():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("trash", False), ("achlich", True)]
    auto = toxicity.LexiconAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    words = [t for t, _ in terms] + ["idi0t", "worthles", "worthleess", "wrothless", "scam", "achlichkeit", "achlic", ""]
    for t, _ in terms * 60:
        w = list(t)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "s", "x"])
        words.append("".join(w))
    for w in words:
        fits = [(distance(w, t), i) for i, (t, p) in enumerate(terms) if not p and distance(w, t) <= toxicity.allowed(t)]
        want = min(fits)[::-1] if fits else ((4, 0) if w.startswith("achlich") else None)
        assert auto.match(w) == want, w


def test_toxicity(spark, odd, empty):
    rng = random.Random(6)
    clean = [f"w{k}" for k in range(500)]
    bad = ["moron", "idiot", "scum", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    model = toxicity.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {t for t, _ in model.terms} == set(bad)
    filler = " ".join(clean[:40])
    probe = [(1, filler), (2, f"{filler} mor0n pathethic {filler}"), (3, f'they said "moron" once {filler} {filler} {filler}'), (4, f"moron idiot {filler}")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert got[1] < 0.3 and got[2] >= 0.7 and got[4] >= 0.7 and got[3] < got[4]
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit([], []) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_fit_holds_each_word_once():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 11))) for _ in range(3000)]
    labels = [int(k % 4 == 0) for k in range(800)]
    texts = [" ".join(rng.choices(vocabulary, k=250)) + " badword" * y for y in labels]
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.terms == [("badword", False)]
    assert peak < 5 * sum(map(len, texts))  # sets of words of every text took 13 times their size


def test_language(spark, sf, docs, odd, empty):
    got = queries.op10_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    model = langid.fit_on(docs)
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3)) and out[4]["lang_pred"] != "und"
    assert langid.identify(empty, model).count() == 0 and langid.fit_on(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert not langid.has_letter("12 ١ .") and langid.has_letter("1é") and langid.has_letter("..a") and not langid.has_letter("")


def test_quality_classifier(spark, sf, docs, odd, empty):
    rows = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    model = quality.fit([r["text"] for r in rows], [0 if r["quality"] == 0 else 2 - r["toxic"] for r in rows], 3)
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails([r["text"].encode() for r in rows])
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert tails[[r["quality"] == 1 for r in rows], 0].mean() > tails[[r["quality"] == 0 for r in rows], 0].mean() + 0.2
    assert len(quality.grade(odd, model).collect()) == len(ODD) and quality.grade(empty, model).count() == 0
    assert all(r["selected"] and r["expected_grade"] is None for r in quality.grade(odd, None).collect())
    assert len(queries.op1_quality(spark, sf).collect()) == docs.count()


# -- scores of the queries against plain readings of the models

def plain_bucket(gram, bits):
    h = (len(gram) * 0x9E3779B1) & 0xFFFFFFFF
    for b, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)):
        h ^= (b + 1) * m & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - bits)


def plain_mean(views, bits, table):
    """Mean of ``table`` over the buckets of all grams of (bytes, size) views."""
    total, n = 0.0, 0
    for k, (data, size) in enumerate(views):
        for i in range(len(data) - size + 1):
            total = total + table[(k << bits) + plain_bucket(data[i : i + size], bits)]
            n += 1
    return total / max(1, n)


def test_quality_scores_are_brute_force(spark, sf, docs, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality.fit_on(docs, labels.selectExpr("doc_id", "case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as grade"), 3)
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = (t or "").encode()
        if len(raw) > 4000:
            continue
        lower = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in raw)
        shape, run = bytearray(), 0
        for b in raw:
            c = 97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
            run = run + 1 if shape and shape[-1] == c and c in (97, 65, 48) else 1
            if run <= 2:
                shape.append(c)
        w = lower.split(b" ")
        w = [x for x in w if x]
        again = bytes(1 if k and w[k] == w[k - 1] else 2 if k > 1 and w[k] == w[k - 2] else 0 for k in range(len(w)))
        f = plain_mean([(lower, 3), (bytes(shape), 3), (bytes(shape), 5), (again, 1)], quality.BITS, model.weights)
        tails = [1 / (1 + np.exp(c - f)) for c in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-9) and got[i]["tail_probability"] == pytest.approx(tails[0], abs=1e-9)
        assert got[i]["selected"] == (got[i]["tail_probability"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_language_scores_are_brute_force(spark, sf, docs, texts):
    model = langid.fit_on(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r["doc_id"]: r for r in queries.op10_language(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        if t is None or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
        elif len(t) <= 3000:
            data = b" " + b" ".join(re.findall(rb"[A-Za-z\x80-\xff]+", t.lower().encode())) + b" "
            z = plain_mean([(data, 3), (data, 4)], langid.BITS, model.logits.astype(float)) + model.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-9)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_toxicity(text, model, met):
    t = (text or "").lower()
    hits, cue, total_quoted = [], -(10**9), 0.0
    tokens = list(toxicity.TOKEN.finditer(t))
    marks = [m.start() for m in re.finditer('["“”„«»]', t)]
    for n, m in enumerate(tokens):
        w = m.group()
        if w not in met:
            p = w if w.isalpha() else w.translate(toxicity.LEET)
            fits = [(edits(p, term), k) for k, (term, opening) in enumerate(model.terms) if not opening and abs(len(p) - len(term)) <= 2]
            fits = [(e, k) for e, k in fits if e <= toxicity.allowed(model.terms[k][0])]
            # several openings may fit: the one that ends first in the word
            heads = [(len(term), k) for k, (term, opening) in enumerate(model.terms) if opening and p.startswith(term)]
            met[w] = min(fits) if fits else (0, min(heads)[1]) if heads else None
        if w in toxicity.CUES:
            cue = n
        if met[w]:
            e, k = met[w]
            weight = model.weights[k][e]
            before = sum(q < m.start() for q in marks)
            if before % 2 and before < len(marks) or n - cue <= toxicity.CUE_REACH:
                total_quoted += weight
                weight *= toxicity.QUOTED
            hits.append((n, weight, k))
    total = sum(w for _, w, _ in hits)
    best = max((sum(w for o, w, _ in hits if 0 <= n - o < toxicity.WINDOW) for n, _, _ in hits), default=0.0)
    terms = sum(max([0.0] + [w for _, w, k in hits if k == term]) for term in {k for _, _, k in hits})
    x = [1.0 if hits else 0.0, *(np.log1p(max(0.0, v)) for v in (total, 100 * total / max(1, len(tokens)), best, terms, total_quoted))]
    z = model.beta[0] + ((np.array(x) - model.centre) / model.scale) @ model.beta[1:]
    return 1 / (1 + np.exp(-z)), len(hits)


def test_toxicity_scores_are_brute_force(spark, sf, docs, texts):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.fit_on(docs, labels)
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    met = {}
    for i, t in texts.items():
        if len(t or "") <= 3000:
            score, hits = plain_toxicity(t, model, met)
            assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["n_hits"] == hits, i
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert any(r["n_hits"] for r in got.values())


def test_training_sample_is_bounded(spark):
    from trialweave.llm import training

    rows = spark.createDataFrame([(i, i % 2, "x" * (1000 if i % 10 else 50_000)) for i in range(100)] + [(7, 1, "x" * 1000)] * 50 + [(None, 1, "y")], "doc_id long, label int, text string").repartition(4)
    seen = lambda texts, labels: (len(texts), sum(map(len, texts)), len(set(zip(texts, labels))))
    assert training.fitted(rows, seen, bound=1000)[0] == 101
    assert training.fitted(rows, seen, bound=30)[0] == 30
    n, size, _ = training.fitted(rows, seen, bound=1000, most_bytes=120_000)
    assert size <= 120_000 and n > 70
    assert training.fitted(rows.limit(0), seen, bound=10) is None
    labels = spark.createDataFrame([(7, 1)] * 500 + [(8, 0), (8, 1), (None, 1), (9, None)], "doc_id long, label int")
    assert sorted((r["doc_id"], r["label"]) for r in training.labelled(rows.select("doc_id", "text"), labels, 10).distinct().collect()) == [(7, 1), (8, 0), (8, 1)]
