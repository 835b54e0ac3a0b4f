"""N-gram Jaccard join by signature trees.

A document is the set of its word n-grams.  Equal sets form one class from the start, and
all further work is on classes.

1. One pass over the texts writes, per document, its set's hash and size, a fixed number of
   routing keys (bands of min-hashes) and a sketch of short min-hash codes.  The number of bands
   follows from the threshold so that two sets at exactly the threshold share none with a chance
   of at most ``MISS`` (1e-9; less for closer sets).  Sets that share a key are tied if their
   sizes allow a link and their sketches differ by no more than linked sets' do (but for a
   chance of at most ``MISS``), so texts that merely share a passage stay apart.  A key with more
   than ``BUCKET`` rows is not compared pair by pair: sets close to its least one are tied to it,
   and the others meet again under finer keys, of that band and each other one together (two
   sets exactly at the threshold share no second band with a chance of 2e-8).  Only keys of
   ``LEVELS`` bands that are still overfull tie all of their sets to the least one without a
   look.  Connected ties are clusters.
2. Each cluster is joined by a signature tree: nodes hold OR-combined token bitmaps,
   size ranges and the largest excess of tokens over bits; a traversal of node pairs drops
   those whose greatest possible overlap is too small, or whose members are already
   connected.  Surviving pairs are checked on the sets themselves.
3. Clusters beyond a block's size are cut into blocks.  Each block is joined with itself and
   with a few pivots, which are the same ones in all blocks of a cluster, so that copies of one
   text are connected across blocks.  What is not in the cluster's largest component then is
   compared, again by trees, with all of the cluster, block pair by block pair.

A group of near copies costs its size: ties are a forest, connected members are not compared
again, a key's rows are counted by partial aggregates and gathered only up to ``BUCKET``, and
no task gathers more than two blocks.  Only sets outside a cluster's largest component meet
all its blocks.

Defined results: null texts and texts without words have an empty set, linked with nothing;
repeated rows are equal sets; rows without an id have links like others, and where no row of a
component has an id its component_id is null; an empty table gives an empty table; other columns
are not read.  Ids are read as long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Scratch, apart, connected_components
from trialweave.llm.text import U64, Words, byte_table, encoded, hidden, mix, shown, slices

MISS = 1e-9
ROWS = 4
#: Rows of one routing key that are compared with each other.
BUCKET = 4096
#: Bands of the finest keys.
LEVELS = 4
#: Most min-hashes of a sketch, and the bits kept of each.
SKETCH, PLANES = 128, 3
#: About the most sets, and n-grams, of a block of a large cluster; pivots of such a cluster.
BLOCK_SETS, BLOCK_GRAMS = 1024, 4_000_000
PIVOTS = 64
LEAF, FAN = 12, 6
_TABLE = byte_table("space")


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def most_apart(threshold: float, hashes: int, miss: float = MISS) -> int:
    """Codes in which sketches of sets at the threshold differ at most, but for a chance of ``miss``."""
    p = (1 - threshold) * (1 - 0.5**PLANES)
    tail, k = 1.0, -1
    while tail > miss and k < hashes:
        k += 1
        tail -= math.comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
    return k


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; a shorter text is one n-gram."""
    w = Words(texts, _TABLE)
    grams = w.grams(n)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            short = np.array([hi - lo], U64)
            for i in range(lo, hi):
                short = mix(short * U64(0x9E3779B97F4A7C15) + w.hash[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    sums = np.array([mix(s).sum(dtype=U64) for s in sets], U64)
    return mix(sums + np.array([len(s) for s in sets], U64) * U64(0xD6E8FEB86659FD93))


def routing_keys(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: ``bands`` 64-bit keys per set, and its sketch: a bit plane after the
    other of its first ``SKETCH`` min-hashes' codes."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (flat ^ (flat >> U64(32))).astype(np.uint32)
    y = (mix(flat) >> U64(32)).astype(np.uint32)
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 31, (2, bands * rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    keys = np.zeros((len(sets), bands), U64)
    sketch = np.zeros((len(sets), PLANES, SKETCH // 64), U64)
    for j in range(bands * rows):
        least = np.minimum.reduceat(x * odd[0, j] + y * odd[1, j], starts).astype(U64)
        keys[:, j // rows] = mix(keys[:, j // rows] + least + U64(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        if j < SKETCH:
            code = mix(least + U64(j))
            for plane in range(PLANES):
                sketch[:, plane, j // 64] |= (code >> U64(plane) & U64(1)) << U64(j % 64)
    return keys, sketch.reshape(len(sets), -1)


def apart_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes in which sketches (rows of ``a`` and of ``b``) differ."""
    x = (a ^ b).reshape(len(a), PLANES, -1)
    return np.bitwise_count(np.bitwise_or.reduce(x, axis=1)).sum(axis=1)


class SignatureTree:
    """Components of sets with Jaccard similarity of at least num / den, among ``sets``."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets])
        self.parent = list(range(len(sets)))
        bits = max(1024, min(1 << 16, 1 << int(4 * max(1, self.size.max()) - 1).bit_length()))
        words = bits // 64
        self.map = np.zeros((len(sets), words), U64)
        for i, s in enumerate(sets):
            b = s % U64(bits)
            np.bitwise_or.at(self.map[i], (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
        self.excess = self.size - np.bitwise_count(self.map).sum(axis=1)
        # Close sets stand together: by size class, then by least n-gram.
        order = sorted(range(len(sets)), key=lambda i: (int(math.log(self.size[i], 1.2)), int(sets[i][0])))
        self.members: list[list[int]] = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.children: list[list[int]] = [[] for _ in self.members]
        lo = [int(self.size[m].min()) for m in self.members]
        hi = [int(self.size[m].max()) for m in self.members]
        ex = [int(self.excess[m].max()) for m in self.members]
        maps = [np.bitwise_or.reduce(self.map[m], axis=0) for m in self.members]
        level = list(range(len(self.members)))
        while len(level) > 1:
            above = []
            for i in range(0, len(level), FAN):
                kids = level[i : i + FAN]
                self.members.append([])
                self.children.append(kids)
                lo.append(min(lo[k] for k in kids))
                hi.append(max(hi[k] for k in kids))
                ex.append(max(ex[k] for k in kids))
                maps.append(np.bitwise_or.reduce(np.array([maps[k] for k in kids]), axis=0))
                above.append(len(self.members) - 1)
            level = above
        self.root = level[0]
        self.lo, self.hi, self.ex, self.maps = lo, hi, ex, maps
        self.one: list[bool] = [False] * len(self.members)  # all members below are connected

    def connect(self, groups: list[int | None]) -> None:
        """Takes sets of the same group (null: none) as connected."""
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            if g is not None:
                a, b = self.find(first.setdefault(g, i)), self.find(i)
                self.parent[max(a, b)] = min(a, b)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def first(self, node: int) -> int:
        while self.children[node]:
            node = self.children[node][0]
        return self.members[node][0]

    def uniform(self, node: int) -> bool:
        if not self.one[node]:
            kids = self.children[node]
            if kids:
                self.one[node] = all(map(self.uniform, kids)) and len({self.find(self.first(k)) for k in kids}) == 1
            else:
                self.one[node] = len({self.find(i) for i in self.members[node]}) == 1
        return self.one[node]

    def linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return self.den * same >= self.num * (len(x) + len(y) - same)

    def possible(self, a: int, b: int) -> bool:
        """Whether some pair below the nodes could reach the threshold."""
        if self.den * self.hi[a] < self.num * self.lo[b] or self.den * self.hi[b] < self.num * self.lo[a]:
            return False
        common = int(np.bitwise_count(self.maps[a] & self.maps[b]).sum())
        # overlap of x and y is at most their common bits and x's (or y's) tokens beyond its bits
        return (common + min(self.ex[a], self.ex[b])) * (self.num + self.den) >= self.num * (self.lo[a] + self.lo[b])

    def join(self) -> list[int]:
        """Root (position) of each set's component."""
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if self.uniform(a) and (a == b or self.uniform(b) and self.find(self.first(a)) == self.find(self.first(b))):
                continue
            if a != b and not self.possible(a, b):
                continue
            ka, kb = self.children[a], self.children[b]
            if not ka and not kb:
                self.compare(a, b)
            elif a == b:
                todo.extend((x, y) for i, x in enumerate(ka) for y in ka[i + 1 :])
                todo.extend((x, x) for x in ka)  # on top: within nodes first
            elif not kb or ka and self.hi[a] - self.lo[a] >= self.hi[b] - self.lo[b]:
                todo.extend((x, b) for x in ka)
            else:
                todo.extend((a, y) for y in kb)
        return [self.find(i) for i in range(len(self.sets))]

    def compare(self, a: int, b: int) -> None:
        for x in self.members[a]:
            for y in self.members[b]:
                if a == b and y <= x:
                    continue
                rx, ry = self.find(x), self.find(y)
                if rx == ry:
                    continue
                sx, sy = int(self.size[x]), int(self.size[y])
                if self.den * min(sx, sy) < self.num * max(sx, sy):
                    continue
                common = int(np.bitwise_count(self.map[x] & self.map[y]).sum()) + min(int(self.excess[x]), int(self.excess[y]))
                if common * (self.num + self.den) >= self.num * (sx + sy) and self.linked(x, y):
                    self.parent[max(rx, ry)] = min(rx, ry)


def sign(docs: DataFrame, n: int, bands: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash (null for empty sets), keys and sketch (null where this task has met the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(encoded(part.column("text")), n)
                hashes = set_hashes(sets)
                if len(met) > 1_000_000:
                    met.clear()
                new = []
                for i, h in enumerate(hashes.tolist()):
                    if len(sets[i]) and h not in met:
                        met.add(h)
                        new.append(i)
                keys: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                if new:
                    found, codes = routing_keys([sets[i] for i in new], bands)
                    for i, row, code in zip(new, found.view(np.int64), codes.view(np.int64), strict=True):
                        keys[i], sketches[i] = row, code
                empty = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(hashes.view(np.int64), mask=empty),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "set_hash", "keys", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_hash long, keys array<long>, sketch array<long>")


def close_forest(names: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, most: int, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs of sets that may be linked connect."""
    names, first = np.unique(names, return_index=True)
    sizes, sketches = sizes[first], sketches[first]
    edges, left = [], np.arange(1, len(names))
    near = [0]
    while len(left):
        if not near:
            near, left = [int(left[0])], left[1:]
            continue
        i = near.pop()
        fits = (den * np.minimum(sizes[left], sizes[i]) >= num * np.maximum(sizes[left], sizes[i])) & (apart_codes(sketches[left], sketches[i : i + 1]) <= most)
        edges.extend((int(names[i]), int(x)) for x in names[left[fits]])
        near.extend(left[fits].tolist())
        left = left[~fits]
    return edges


def _ties(most: int, num: int, den: int):
    """Edges (a, b) of the buckets in rows (key, set_hash, n, sketch) sorted by key; a bucket has ``BUCKET`` rows at most."""

    def settle(key: np.ndarray, name: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(opens)
        bucket = np.cumsum(opens) - 1
        head = starts[bucket]
        # Most buckets are copies of their first set; the others are compared pair by pair.
        fits = (den * np.minimum(size, size[head]) >= num * np.maximum(size, size[head])) & (apart_codes(sketch, sketch[head]) <= most)
        plain = np.logical_and.reduceat(fits, starts)
        at = plain[bucket] & (name != name[head])
        pairs = [np.stack([name[head][at], name[at]], axis=1)]
        ends = np.append(starts[1:], len(key))
        for k in np.flatnonzero(~plain):
            own = slice(starts[k], ends[k])
            if edges := close_forest(name[own], size[own], sketch[own], most, num, den):
                pairs.append(np.array(edges, np.int64))
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)  # the same two sets often meet in many buckets
        return pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("key", "set_hash", "n")]
            now.append(batch.column("sketch").flatten().to_numpy().view(U64).reshape(-1, SKETCH // 64 * PLANES))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.flatnonzero(now[0] == now[0][-1])[0])
            if cut:
                yield settle(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None:
            yield settle(*held)

    return run


def _apart_column(a: Column, b: Column) -> Column:
    """``apart_codes`` as an expression."""
    out = F.lit(0)
    for word in range(SKETCH // 64):
        x = F.lit(0).cast("long")
        for plane in range(PLANES):
            at = plane * (SKETCH // 64) + word
            x = x.bitwiseOR(a[at].bitwiseXOR(b[at]))
        out = out + F.bit_count(x)
    return out


def tied(signed: DataFrame, scratch: Scratch, num: int, den: int, bands: int) -> DataFrame:
    """Edges (a, b) between sets that share a routing key and may be linked."""
    own = signed.where("keys is not null")
    most = most_apart(num / den, min(SKETCH, bands * ROWS))
    near = most // 4
    sketches = own.groupBy("set_hash", apart("set_hash")).agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).drop("_apart")
    rows = own.select(F.explode("keys").alias("key"), "set_hash", F.lit(None).cast("array<int>").alias("used"))
    ties = []
    for level in range(1, LEVELS + 1):
        counts = rows.groupBy("key", apart("key")).agg(F.count("*").alias("rows"), F.min("set_hash").alias("least"), F.max("set_hash").alias("most")).where("least <> most").select("key", "rows", "least")
        met = scratch.table(rows.join(counts.hint("merge"), "key"), f"met-{level}")
        few = met.where(F.col("rows") <= BUCKET).select("key", "set_hash").join(sketches.hint("merge"), "set_hash").select("key", "set_hash", "n", "sketch")
        ties.append(few.repartition("key").sortWithinPartitions("key").mapInArrow(_ties(most, num, den), "a long, b long"))
        many = met.where(F.col("rows") > BUCKET)
        if not many.head(1):
            break
        if level == LEVELS:
            ties.append(many.select(F.col("set_hash").alias("a"), F.col("least").alias("b")))
            break
        # Whatever is linked with a set near the least one lies within ``most + near`` of the least one.
        centres = sketches.select(F.col("set_hash").alias("least"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"))
        seen = many.join(sketches.hint("merge"), "set_hash").join(centres.hint("merge"), "least").withColumn("_apart", _apart_column(F.col("sketch"), F.col("_sketch")))
        low, high = F.least("n", "_n"), F.greatest("n", "_n")
        seen = scratch.table(seen.select("key", "set_hash", "used", "least", ((F.col("_apart") <= near) & (den * low >= num * high)).alias("close"), ((F.col("_apart") <= most + near) & (den * den * low >= num * num * high)).alias("tie")), f"seen-{level}")
        ties.append(seen.where("tie").select(F.col("set_hash").alias("a"), F.col("least").alias("b")))
        others = seen.where("not close").join(own.select("set_hash", "keys").hint("merge"), "set_hash")
        used = F.coalesce("used", F.array((F.array_position("keys", F.col("key")) - 1).cast("int")))
        finer = others.withColumn("used", used).withColumn("band", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: ~F.array_contains("used", j))))
        finer = finer.withColumn("used", F.array_sort(F.array_append("used", F.col("band"))))
        key = F.xxhash64(F.transform("used", lambda j: F.struct(j, F.get("keys", j))))
        rows = scratch.table(finer.select(key.alias("key"), "set_hash", "used").distinct(), f"finer-{level}")
    out = ties[0]
    for more in ties[1:]:
        out = out.unionByName(more)
    return out


def _join_clusters(n: int, num: int, den: int):
    """Of rows (task, set_hash, known, home, text) sorted by task: links as (a, b), and for rows
    that are at ``home`` their text as (set_hash, null, text)."""

    def settle(rows: dict[int, tuple[bytes, int | None]]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        names, texts = list(rows), [t for t, _ in rows.values()]
        sets: list[np.ndarray] = []
        at, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > (2 << 20) or i == len(texts) - 1:
                sets += shingle_sets(texts[at : i + 1], n)
                at, held = i + 1, 0
        right = np.flatnonzero(set_hashes(sets).view(np.int64) == np.array(names))  # an id may stand for other texts too
        if len(right) < 2:
            return
        tree = SignatureTree([sets[i] for i in right], num, den)
        known = [k for _, k in rows.values()]
        tree.connect([known[i] for i in right])
        root = tree.join()
        own = np.array(names)[right]
        low: dict[int, int] = {}
        for h, r in zip(own.tolist(), root, strict=True):
            low[r] = min(low.get(r, h), h)
        pairs = [(h, low[r]) for h, r in zip(own.tolist(), root, strict=True) if h != low[r]]
        if pairs:
            none = pa.nulls(len(pairs), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), none], ["a", "b", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            kept = batch.filter(batch.column("home"))
            if len(kept):
                yield pa.RecordBatch.from_arrays([kept.column("set_hash"), pa.nulls(len(kept), pa.int64()), kept.column("text")], ["a", "b", "text"])
            for task, h, known, text in zip(*(batch.column(c).to_pylist() for c in ("task", "set_hash", "known")), encoded(batch.column("text")), strict=True):
                if task != now:
                    yield from settle(rows)
                    now, rows = task, {}
                rows[h] = text, known
        yield from settle(rows)

    return run


def _joined(texts: DataFrame, scratch: Scratch, name: str, n: int, num: int, den: int) -> DataFrame:
    """Written (a, b, text) of ``_join_clusters``."""
    rows = texts.select("task", "set_hash", "known", "home", "text")
    return scratch.table(rows.repartition("task").sortWithinPartitions("task").mapInArrow(_join_clusters(n, num, den), "a long, b long, text string"), name)


def _across_blocks(placed: DataFrame, found: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    """Links of large clusters beyond those ``found`` inside their blocks.

    Sets of a cluster's largest component (main) are connected already; the others (rest)
    are cut into blocks of their own and meet every block of main and of the rest.
    """
    known = connected_components(found.where("b is not null").select("a", "b"), scratch, "inside")
    state = placed.where("blocks > 1").join(known, placed["set_hash"] == known["node"], "left").select("cluster", "set_hash", "n", "block", "blocks", F.coalesce("root", "set_hash").alias("known"))
    state = scratch.table(state, "state")
    parts = state.groupBy("cluster", "known").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    mains = parts.groupBy("cluster").agg(F.max(F.struct("sets", "known"))["known"].alias("main"), F.count("*").alias("parts"), F.sum("sets").alias("all_sets"), F.sum("grams").alias("all_grams"), F.max(F.struct("sets", "known", "grams")).alias("most"))
    rest = F.greatest(F.ceil((F.col("all_sets") - F.col("most.sets")) / BLOCK_SETS), F.ceil((F.col("all_grams") - F.col("most.grams")) / BLOCK_GRAMS)).cast("int")
    open_ones = scratch.table(mains.where("parts > 1").select("cluster", "main", rest.alias("rests")), "open")
    dealt = state.join(open_ones.hint("merge"), "cluster").withColumn("own", F.when(F.col("known") != F.col("main"), F.pmod(F.xxhash64("set_hash"), F.col("rests")).cast("int")))
    meets = F.expr(
        "case when own is null then transform(sequence(0, rests - 1), r -> struct('main' as kind, block as x, r as y)) "
        "else concat(transform(sequence(0, blocks - 1), m -> struct('main' as kind, m as x, own as y)), "
        "transform(filter(sequence(0, rests - 1), r -> r <> own), r -> struct('rest' as kind, least(r, own) as x, greatest(r, own) as y))) end"
    )
    tasks = dealt.withColumn("meet", F.explode(meets)).select("set_hash", "known", F.xxhash64("cluster", "meet").alias("task"), F.lit(False).alias("home"))
    texts = found.where("text is not null").select(F.col("a").alias("set_hash"), "text")
    return _joined(texts.join(tasks.hint("merge"), "set_hash"), scratch, "across", n, num, den).select("a", "b")


def component_rows(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, text_key (hash of the text), n_shingles, component_id and
    is_first: whether the row's id and text are those of its component's first row (least id,
    rows without an id last, then least text_key).  Links are den * overlap >= num * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    bands = bands_for(num / den)
    signed = scratch.table(sign(rows, n, bands), "sets")
    clusters = connected_components(tied(signed, scratch, num, den, bands), scratch, "clusters")  # node, root
    scratch.drop(*(f"{name}-{k}" for name in ("met", "seen", "finer") for k in range(1, LEVELS + 1)))

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = signed.where("set_hash is not null").groupBy("set_hash").agg(F.min(place).alias("own"), F.first("n_shingles").alias("n"))
    near = classes.join(clusters, classes["set_hash"] == clusters["node"]).select("set_hash", "n", "own.doc_id", "own.text_key", F.col("root").alias("cluster"))
    near = scratch.table(near, "near")
    scratch.drop("clusters")
    sizes = near.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    blocks = sizes.select("cluster", "sets", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    blocks = scratch.table(blocks, "blocks")  # with a shuffle of its own Spark may split a hot cluster in the join
    placed = near.join(blocks.hint("merge"), "cluster").withColumn("block", F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int"))
    # Pivots together are no larger than about one block.
    pivot = F.pmod(F.xxhash64("set_hash", F.lit("pivot")), F.col("sets")) < F.least(F.lit(PIVOTS), F.ceil(F.col("sets") / F.col("blocks")))
    parts = F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = placed.withColumn("part", F.explode(parts)).select(
        "doc_id", "text_key", "set_hash", F.xxhash64("cluster", "part").alias("task"), F.lit(None).cast("long").alias("known"), ((F.col("blocks") > 1) & (F.col("part") == F.col("block"))).alias("home")
    )
    texts = rows.join(tasks.hint("merge"), rows["doc_id"].eqNullSafe(tasks["doc_id"]) & (rows["text_key"] == tasks["text_key"]))
    found = _joined(texts, scratch, "links", n, num, den)
    links = found.where("b is not null").select("a", "b")
    if blocks.where("blocks > 1").head(1):
        roots = connected_components(links.unionByName(_across_blocks(placed, found, scratch, n, num, den)), scratch, "roots")
    else:  # each cluster was one task, whose links are stars
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))

    named = classes.select("set_hash", "own").join(roots, classes["set_hash"] == roots["node"], "left").select("set_hash", "own", F.coalesce("root", "set_hash").alias("class"))
    first = named.groupBy("class", apart("class")).agg(F.min("own").alias("first")).select("class", "first")
    labels = scratch.table(named.join(first, "class").select("set_hash", "first"), "labels")
    scratch.drop("near", "blocks", "links", "inside", "state", "open", "across", "roots")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return signed.join(labels.hint("merge"), "set_hash", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("first").isNotNull(), same).otherwise(F.lit(True)).alias("is_first")
    )


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of ``component_rows``."""
    return component_rows(docs, n=n, num=num, den=den).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of the rows of ``docs`` that stay when of each component one row does: the first
    by id, rows without an id last, then by text.  Rows without words all stay.  Ids need not be
    unique: rows of one id with unlike texts are told apart by their text; of several rows with the
    first id and text the one whose columns come first as JSON stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "first")
    found = scratch.table(component_rows(docs, n=n, num=num, den=den), "rows")
    several = found.where("is_first and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    gone = found.where("not is_first").select("doc_id", "text_key").distinct()

    def parts(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_text"))

    own, inner = hidden(docs, "doc_id", "text")
    id_ = own["doc_id"].cast("long")
    marked = own.withColumns({"_none": id_.isNull(), "_id": F.coalesce(id_, F.lit(0)), "_text": F.xxhash64("text")})
    on = ["_none", "_id", "_text"]
    if not several.head(1):  # no row is there twice
        kept = marked.join(parts(gone).hint("merge"), on, "left_anti")
    else:
        once = parts(several)
        kept = marked.join(parts(gone.unionByName(several)).hint("merge"), on, "left_anti")
        alike = marked.join(once.hint("merge"), on, "left_semi").groupBy(*on).agg(F.min_by(F.struct(*inner), F.to_json(F.struct(*inner))).alias("_row"))
        kept = kept.select(*inner).unionByName(alike.select(*(F.col(f"_row.{c}").alias(c) for c in inner)))
    return shown(kept, inner, docs.columns)
