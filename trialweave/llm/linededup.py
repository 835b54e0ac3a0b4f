"""Removal of repeated passages by overlapping three-line windows.

A line is a stretch between line breaks; one of more than ``fold_words`` words is
folded at places that its own words choose: a gap between words that comes first, sentence
ends before others and then by hash, among ``REACH`` gaps on either side.  So a passage is
folded alike wherever it stands, and about fifty words hold three whole pieces.  Stretches of
over ``MOST_PIECE`` words without such a gap (one word over and over) are folded by counting.  Blank lines are skipped.  Each window of three consecutive lines
has a 96-bit hash; of a window that occurs more than once anywhere, the first occurrence
(least document id, then place) stays and the lines of all later ones are removed,
overlapping windows together.

Texts are hashed once, into a written table of narrow rows.  Hashes that occur again are found
by partial aggregates; only their rows are looked at further.  The ways back, to the rows and
to the texts, are joins in which Spark may split hot keys; no group of rows is ever gathered.

Defined results: null texts stay null, texts of fewer than three lines stay as they are;
rows that repeat both id and text count as one occurrence and are treated alike; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Scratch, apart
from trialweave.llm.text import U64, hidden, mix, slices

LINES = 3
FOLD_WORDS = 12
#: A piece of a long line has more words than this.
REACH = 4
#: Words from which on a piece without a place to fold is folded by counting.
MOST_PIECE = 64


def _folds(text: str, line_at: np.ndarray, fold_words: int) -> np.ndarray:
    """Ascending character places at which the long lines of ``text`` are folded."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.zeros(len(code) + 2, np.int8)
    blank[1:-1] = (code == 32) | (code == 9)
    edge = np.diff(blank)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # gaps between words
    line = np.searchsorted(line_at, start, "right") - 1
    wide = np.bincount(line, minlength=len(line_at))[line] >= fold_words
    start, end, line = start[wide], end[wide], line[wide]
    n = len(start)
    if not n:
        return end
    stop = np.isin(code[np.maximum(start - 1, 0)], (33, 46, 63)) & (start > line_at[line])
    value = np.zeros(n, U64)
    floor = line_at[line]
    for j in range(1, 7):  # the six characters before the gap, those of its own line
        value += np.where(start - j >= floor, code[np.maximum(start - j, 0)], 0).astype(U64) * U64(pow(0xA24BAED4963EE407, j, 1 << 64))
    value = mix(value) >> U64(1) | np.where(stop, 0, 1 << 63).astype(U64)  # sentence ends first
    least = np.zeros(n, bool)
    least[REACH : max(REACH, n - REACH)] = line[: max(0, n - 2 * REACH)] == line[2 * REACH :]
    for j in range(1, min(REACH, n - 1) + 1):
        least[j:] &= value[j:] < value[:-j]
        least[:-j] &= value[:-j] < value[j:]
    # Words that repeat over and over offer no such place: what is still long is folded by counting.
    here = np.arange(n)
    opens, closes = np.append(True, line[1:] != line[:-1]), np.append(line[1:] != line[:-1], True)
    before = np.append(-1, np.where(least, here, -1)[:-1])
    before = np.maximum.accumulate(np.where(opens, here - 1, before))
    after = np.minimum.accumulate(np.where(least, here, np.where(closes, here + 1, n))[::-1])[::-1]
    run = here - before
    return end[least | (after - before > MOST_PIECE) & (run > 0) & (run % (2 * REACH) == 0) & (after - here >= 2 * REACH)]


def units_of(texts: list[str], fold_words: int = FOLD_WORDS) -> list[list[tuple[int, int]]]:
    """``units`` of each text, found together."""
    whole = "\n".join(texts)
    lines, starts, at = [], [], 0
    for t in texts:
        own = t.split("\n")
        lines.append(own)
        for line in own:
            starts.append(at)
            at += len(line) + 1
    cuts = _folds(whole, np.array(starts, np.int64), fold_words).tolist() if texts else []
    cuts.append(at + 1)
    out, k, at = [], 0, 0
    for own in lines:
        base, spans = at, []
        for line in own:
            a, stop = at - base, at - base + len(line)
            if line and not line.isspace():
                while cuts[k] < base + stop:
                    spans.append((a, cuts[k] - base))
                    a = cuts[k] - base
                    k += 1
                spans.append((a, stop))
            at += len(line) + 1
            while cuts[k] < at:
                k += 1
        out.append(spans)
    return out


def units(text: str, fold_words: int = FOLD_WORDS) -> list[tuple[int, int]]:
    """Character spans of the lines with a word, long ones folded."""
    return units_of([text], fold_words)[0]


def window_hashes(text: str, spans: list[tuple[int, int]]) -> list[int]:
    lines = [text[a:b].strip() for a, b in spans]
    return [xxhash.xxh3_128_intdigest("\n".join(lines[i : i + LINES]).encode("utf-8", "surrogatepass")) for i in range(len(lines) - LINES + 1)]


def without(text: str, places: list[int], spans: list[tuple[int, int]] | None = None) -> tuple[str, int, int]:
    """Text without the windows that begin at ``places``; its lines; lines removed."""
    spans = units(text) if spans is None else spans
    gone = sorted({i for p in places for i in range(p, min(p + LINES, len(spans)))})
    parts, at = [], 0
    for i in gone:
        a, b = spans[i]
        if b < len(text) and text[b] == "\n":
            b += 1
        parts.append(text[at:a])
        at = max(at, b)
    parts.append(text[at:])
    return "".join(parts), len(spans), len(gone)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _text_key(text: Column) -> Column:
    """48 bits that tell texts with the same id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 16)


def dedup_lines(docs: DataFrame, *, fold_words: int = FOLD_WORDS) -> DataFrame:
    """All columns of ``docs`` with the new text, and n_lines and n_removed behind them
    (columns of ``docs`` with these two names are left out)."""
    docs = docs.drop("n_lines", "n_removed")
    outer = docs.columns
    docs, _ = hidden(docs, "doc_id", "text")
    keyed = docs.select(docs["doc_id"].alias("_id"), _text_key(docs["text"]).alias("_key"), docs["text"].alias("_text"))
    id_kind = dict(docs.dtypes)["doc_id"]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                row, h1, h2, place = [], [], [], []
                texts = part.column("_text").to_pylist()
                for r, (text, spans) in enumerate(zip(texts, units_of(texts, fold_words), strict=True)):
                    for i, h in enumerate(window_hashes(text, spans)):
                        row.append(r)
                        h1.append(_signed(h >> 64))
                        h2.append((h & 0xFFFFFFFF) - (1 << 31))
                        place.append(i)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1, pa.int64()), pa.array(h2, pa.int32()), part.column("_id").take(at), part.column("_key").take(at), pa.array(place, pa.int32())],
                    ["h1", "h2", "_id", "_key", "place"],
                )

    scratch = Scratch(docs.sparkSession, "lines")
    windows = scratch.table(keyed.where("_text is not null").mapInArrow(hashes, f"h1 long, h2 int, _id {id_kind}, _key long, place int"), "windows")
    again = windows.groupBy("h1", apart("h1")).agg(F.count("*").alias("n")).where("n > 1").select("h1")
    met = scratch.table(windows.join(again.hint("merge"), "h1"), "met")
    scratch.drop("windows")
    where = F.struct("_id", "_key", "place")
    first = met.groupBy("h1", "h2", apart("h1")).agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first != last").select("h1", "h2", "first")
    later = met.join(first.hint("merge"), ["h1", "h2"]).where(where != F.col("first"))
    places = scratch.table(later.groupBy("_id", "_key").agg(F.collect_set("place").alias("_places")), "places")
    scratch.drop("met")

    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    tagged = docs.withColumn("_own", _text_key(docs["text"]))
    joined = tagged.join(places.hint("merge"), docs["doc_id"].eqNullSafe(places["_id"]) & (tagged["_own"] == places["_key"]), "left").select(*(docs[c] for c in names), "_places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                new, lines, removed = [], [], []
                texts = part.column("text").to_pylist()
                spans = units_of([t or "" for t in texts], fold_words)
                for text, gone, own in zip(texts, part.column("_places").to_pylist(), spans, strict=True):
                    t, n, k = (None, 0, 0) if text is None else without(text, gone or [], own)
                    new.append(t)
                    lines.append(n)
                    removed.append(k)
                columns = [pa.array(new, part.column("text").type) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    out = joined.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_lines long, n_removed long")
    return out.toDF(*outer, "n_lines", "n_removed")
