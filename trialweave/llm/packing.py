"""Packing of tokenised documents into fixed windows by Karmarkar-Karp differencing.

Every document is tokenised whole and closed by an end id.  Stretches of a full
window become windows of their own; the rest of a document is cut into pieces of at
most ``piece`` ids, and each group of pieces is spread over ``k`` windows by multiway
differencing: partial partitions (one load per window) are merged largest spread first,
the heaviest load of one with the lightest of the other.  ``k`` starts at the least
number that could hold the group and rises whenever the heaviest window is over capacity.

Tasks pack what they read: no shuffle, and a window never holds ids of two tasks.  A
recomputed task gives the same rows, since window ids come from the partition's number
and a counter.

Defined results: a null or empty text is the end id alone; equal rows are packed each
for itself; no rows give no rows; other columns are not read.  Ids are read as long.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trialweave.llm.text import byte_table, encoded, slices

#: Distinct words whose ids a table of a worker holds.  A worker has two tables: when the newer one is
#: full the older one goes, so words that come often stay known.
CACHE_WORDS = 400_000
_SPACE = byte_table("space", lower=False)
_LOWER = byte_table("space")
#: Lower-case Latin letters (one code point each, lower case of themselves), then ASCII punctuation.
_PLAIN_WORD = re.compile("([a-zß-öø-ÿœ]+)([!-/:-@\\[-`{-~]*)")


class WordTokenizer:
    """Ids of whole texts through a table of distinct words.

    Exact for vocabularies whose splitting never joins text across ASCII white space, which
    lower-case letter by letter, take runs of letters and runs of punctuation as words and
    mark a word's last token by ``</w>``.  A text is lower-cased before the table is asked
    only when that cannot matter: no special-token opening and no combining mark.

    Unknown words of lower-case Latin letters, with punctuation behind them or not, are
    encoded many to a call and told apart by their last tokens; all others one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}  # runs of letters, runs of punctuation
        size = self.tokenizer.get_vocab_size()
        self.last = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, out, pos = np.fromiter((i for ids in found for i in ids), "<u4").tobytes(), [], 0
        for ids in found:
            out.append(flat[pos : pos + 4 * len(ids)])
            pos += 4 * len(ids)
        return out

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 8_192):
            some = parts[at : at + 8_192]
            runs = [some[i : i + 64] for i in range(0, len(some), 64)]
            for run, ids in zip(runs, self._encode([" ".join(r) for r in runs]), strict=True):
                ends = (np.flatnonzero(self.last[np.frombuffer(ids, "<u4")]) + 1) * 4
                if len(ends) == len(run) and ends[-1] == len(ids):
                    begin = 0
                    for w, end in zip(run, ends.tolist(), strict=True):
                        self.parts[w] = ids[begin:end]
                        begin = end
                else:
                    self.parts.update(zip(run, self._encode(run), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        split, other = [], []
        for w in words:
            m = _PLAIN_WORD.fullmatch(w.decode("utf-8", "replace"))
            if m:
                split.append((w, m[1], m[2]))
            else:
                other.append(w)
        parts = self.parts
        self._learn_parts(list({x for _, a, b in split for x in (a, b) if x and x not in parts}))
        for w, a, b in split:
            self.table[w] = parts[a] + parts[b] if b else parts[a]
        for at in range(0, len(other), 8_192):
            some = other[at : at + 8_192]
            self.table.update(zip(some, self._encode([w.decode("utf-8", "replace") for w in some]), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.table) > CACHE_WORDS:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        split = [t.translate(_SPACE if b"<|" in t or b"\xcc" in t or b"\xcd" in t else _LOWER).split() for t in texts]
        found = [list(map(table.get, words)) for words in split]
        holes = [(ids, words, [i for i, x in enumerate(ids) if x is None]) for words, ids in zip(split, found, strict=True) if None in ids]
        new = {words[i] for _, words, at in holes for i in at}
        table.update((w, older[w]) for w in new if w in older)
        self._learn([w for w in new if w not in table])
        for ids, words, at in holes:
            for i in at:
                ids[i] = table[words[i]]
        return list(map(b"".join, found))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's own one: its tables serve all tasks that the worker runs."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def difference(sizes: list[int], k: int) -> tuple[int, list[list[int]]]:
    """Multiway differencing of ``sizes`` over k bins: largest load, and the items of each bin.

    A partial partition is (loads above its least, their items), heaviest first, without
    the zero loads; ``base`` keeps the least load that was taken off, so that loads stay true.
    """
    heap: list[tuple[int, int, list[tuple[int, tuple]], list[tuple]]] = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, (i,))], []))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, za = heapq.heappop(heap)
        _, _, b, zb = heapq.heappop(heap)
        # za, zb: items of bins at the least load (0 after taking it off), where any are
        free = k - len(a) - len(b)
        if free >= 0 and not za and not zb:
            merged = sorted(a + b, key=lambda x: -x[0])
            rest: list[tuple] = []
        else:
            left = a + [(0, t) for t in za] + [(0, ())] * (k - len(a) - len(za))
            right = b + [(0, t) for t in zb] + [(0, ())] * (k - len(b) - len(zb))
            merged = sorted(((x + y, (s, t) if s and t else s or t) for (x, s), (y, t) in zip(left, reversed(right), strict=True)), key=lambda x: -x[0])
            rest = []
        if len(merged) == k:
            least = merged[-1][0]
            if least:
                merged = [(x - least, t) for x, t in merged]
            rest = [t for x, t in merged if not x and t]
            merged = [(x, t) for x, t in merged if x]
        spread = merged[0][0] if merged else 0
        heapq.heappush(heap, (-spread, n, merged, rest))
        n += 1
    if not heap:
        return 0, []
    bins = []
    for t in [t for _, t in heap[0][2]] + heap[0][3]:
        items, todo = [], [t]
        while todo:
            x = todo.pop()
            for y in x:
                if isinstance(y, tuple):
                    todo.append(y)
                else:
                    items.append(y)
        bins.append(sorted(items))
    return max(sum(sizes[i] for i in x) for x in bins), bins


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest windows from the least possible number on for which differencing fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        most, bins = difference(sizes, k)
        if most <= capacity:
            return bins
        k += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    piece: int = 512,
    windows: int = 96,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; ``with_ids`` adds the ids themselves.

    ``windows``: about so many windows are filled by one differencing, which bounds its memory.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(vocabulary)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        rows: list[tuple] = []
        waiting: list[tuple] = []  # (doc_id, start, piece's ids, doc_tokens)
        held = 0

        def settle() -> None:
            nonlocal sequence, held
            for items in pack_group([len(x[2]) // 4 for x in waiting], capacity):
                offset = 0
                for i in items:
                    doc, start, ids, total = waiting[i]
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            waiting.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [n for n, _ in _ARROW]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.ids(encoded(part.column("text"))), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while total - start >= capacity:
                        full = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, capacity, zlib.crc32(full), total, sequence, 0, full))
                        sequence += 1
                        start += capacity
                    left = total - start
                    pieces = -(-left // piece)
                    for j in range(pieces):
                        stop = start + -(-(total - start) // (pieces - j))
                        waiting.append((doc, start, ids[4 * start : 4 * stop], total))
                        held += stop - start
                        start = stop
                    if held >= windows * capacity:
                        settle()
                if len(rows) > 5_000:
                    yield flush()
        if waiting:
            settle()
        yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
