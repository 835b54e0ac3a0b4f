"""Benchmark decontamination by winnowed fingerprints.

From any run of ``window`` words both sides keep the least hash of each
``window - k + 1`` consecutive k-grams, so a shared run of ``window`` words always
shares a kept k-gram.  Kept k-grams of a document are looked up among those of the
benchmark and each hit is extended to both sides word by word (compared as text, not
as hashes); runs of at least ``window`` words count.  Items with fewer words are one
window each and are looked up by the hash of the whole item.

The benchmark's index goes to the tasks only in blocks of at most ``block_bytes`` of
text: one block is one pass without a shuffle, more blocks are one pass each whose
found spans are united per document.

Defined results: null or empty texts have no words and are clean; items without
words or id are ignored; repeated items count once by id; repeated documents are judged
each for itself; an empty benchmark leaves all clean.  Ids of documents and items are read as
long; texts that are no numbers fail, as in any cast.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import U64, Words, byte_table, encoded, slices

TABLE = byte_table("alnum")
#: Text of the benchmark that one index may hold.
BLOCK_BYTES = 32 << 20
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def kept(hashes: np.ndarray, width: int) -> np.ndarray:
    """Marks each hash that is the least of some ``width`` consecutive ones (all of equal least ones)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(len(hashes), bool)
    least = hashes[:n].copy()
    for j in range(1, width):
        np.minimum(least, hashes[j : j + n], out=least)
    out = np.zeros(len(hashes), bool)
    for j in range(width):
        out[j : j + n] |= hashes[j : j + n] == least
    return out


class Index:
    """Fingerprints of one block of items: ``items`` are (id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], window: int, k: int) -> None:
        self.window, self.k = window, k
        ids: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item, text in items:
            if item is not None and (words := tuple((text or "").encode().translate(TABLE).split())):
                ids[words].append(item)
        self.words = list(ids)  # different items with the same words share an entry
        self.ids = [sorted(set(x)) for x in ids.values()]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, words in enumerate(self.words):
            hashed = Words([b" ".join(words)], TABLE)
            if len(words) < window:
                self.short[len(words)][int(hashed.grams(len(words))[0])].append(i)
            else:
                grams = hashed.grams(k)
                for q in np.flatnonzero(kept(grams, window - k + 1)):
                    self.places[int(grams[q])].append((i, int(q)))
        self.places, self.short = dict(self.places), {n: dict(x) for n, x in self.short.items()}
        self.sorted = np.sort(np.fromiter(self.places, U64, len(self.places)))
        self.short_sorted = {n: np.sort(np.fromiter(x, U64, len(x))) for n, x in self.short.items()}

    @staticmethod
    def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Positions whose hash is known; a bitmap answers for nearly all of them."""
        if not len(known) or not len(hashes):
            return np.zeros(0, np.int64)
        shift = U64(64 - max(16, min(24, len(known).bit_length() + 6)))
        seen = np.zeros(1 << (64 - int(shift)), bool)
        seen[known >> shift] = True
        maybe = np.flatnonzero(seen[hashes >> shift])
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[at] == hashes[maybe]]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text: its words, merged hit spans, entries with an occurring window."""
        w = Words(texts, TABLE)
        grams = w.grams(self.k)
        # A gram over a text's end never counts; the last words of a text may start none.
        for stop in w.first[1:]:
            grams[max(0, stop - self.k + 1) : stop] = _NONE
        at = np.flatnonzero(kept(grams, self.window - self.k + 1) & (grams != _NONE))
        long_at = at[self.among(grams[at], self.sorted)]
        found: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)  # text -> (word, length or 0)
        for p, d in zip(long_at.tolist(), (np.searchsorted(w.first, long_at, "right") - 1).tolist(), strict=True):
            found[d].append((p, int(grams[p]), 0))
        for n, known in self.short_sorted.items():
            hashes = w.grams(n)
            near = self.among(hashes, known)
            for p, d in zip(near.tolist(), (np.searchsorted(w.first, near, "right") - 1).tolist(), strict=True):
                if p + n <= w.first[d + 1]:
                    found[d].append((p, int(hashes[p]), n))
        out = []
        for d, text in enumerate(texts):
            lo = int(w.first[d])
            count = int(w.first[d + 1]) - lo
            spans, items = self.extend(text.translate(TABLE).split(), lo, found[d]) if d in found else ([], set())
            out.append((count, spans, items))
        return out

    def extend(self, words: list[bytes], lo: int, hits: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[int]]:
        spans, items, done = [], set(), {}
        for p, h, n in hits:
            p -= lo
            if n:
                for i in self.short[n][h]:
                    if tuple(words[p : p + n]) == self.words[i]:
                        spans.append((p, p + n))
                        items.add(i)
                continue
            for i, q in self.places[h]:
                if done.get((i, p - q), -1) > p:
                    continue
                item = self.words[i]
                a = b = 0
                while p - a and q - a and words[p - a - 1] == item[q - a - 1]:
                    a += 1
                while p + b < len(words) and q + b < len(item) and words[p + b] == item[q + b]:
                    b += 1
                done[(i, p - q)] = p + b
                if b and a + b >= self.window:
                    spans.append((p - a, p + b))
                    items.add(i)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_COLUMNS = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def _pass(docs: DataFrame, index: Index, hits_only: bool) -> DataFrame:
    names = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = index.search(encoded(part.column("text")))
                if hits_only:
                    keep = [i for i, r in enumerate(rows) if r[1]]
                    part, rows = part.take(pa.array(keep, pa.int64())), [rows[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPAN),
                        pa.array([sorted({x for i in r[2] for x in index.ids[i]}) for r in rows], pa.list_(pa.int64())),
                    ],
                    [*names, "n_words", "spans", "items"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, {_COLUMNS}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, text_key, n_words, spans (hit word ranges,
    merged), items (ids with an occurring window)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _pass(rows, Index([tuple(r) for r in items.collect()], window, k), False)
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = None
    for b in range(blocks):
        one = _pass(rows, Index([tuple(r) for r in items.where(share == b).collect()], window, k), True)
        parts = one if parts is None else parts.unionByName(one)
    keys = ["doc_id", "text_key"]
    found = parts.distinct().groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found_items"))
    alone = _pass(rows, Index([], window, k), False).drop("spans", "items")
    on = alone["doc_id"].eqNullSafe(found["doc_id"]) & (alone["text_key"] == found["text_key"])
    none_span, none_item = F.expr("cast(array() as array<struct<start:int,end:int>>)"), F.expr("cast(array() as array<long>)")
    merged = F.expr(
        "aggregate(array_sort(found), cast(array() as array<struct<start:int,end:int>>), (acc, x) -> case when size(acc) > 0 and element_at(acc, -1).end >= x.start "
        "then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) else concat(acc, array(x)) end)"
    )
    return alone.join(found, on, "left").select(alone["doc_id"], alone["text_key"], "n_words", F.coalesce(merged, none_span).alias("spans"), F.coalesce("found_items", none_item).alias("items"))


def verdicts(found: DataFrame) -> DataFrame:
    """Digest of ``find_contamination``: counts, hash of the item ids, and the rule n_hit > 0 and 20 n_hit >= n_words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that the rule of ``verdicts`` leaves, with all their columns.

    With one block of benchmark text the rows are filtered where they are read."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        bad = verdicts(find_contamination(docs, benchmark, window=window, k=k, block_bytes=block_bytes)).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
        return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_key"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], window, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                hits = [(n, sum(b - a for a, b in spans)) for n, spans, _ in index.search(encoded(part.column("text")))]
                yield part.filter(pa.array([not (hit and 20 * hit >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def items_digest(ids: list[int]) -> str:
    """What ``items_sha256`` is, in plain Python (for tests and readers)."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
