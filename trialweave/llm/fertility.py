"""Quality rules: text statistics and tokeniser fertility.

Words are runs of bytes other than ASCII white space.  Each distinct word is encoded
once per worker by a public vocabulary with byte fallback; a document's figures are
characters (but for ASCII punctuation) per token, share of byte-fallback tokens and entropy of its tokens in bits.  A document outside a band of its
script is rejected.  Bands are parameters, the same for every input.

Defined results: a null or empty text has zero counts and figures, fails the base rule
and is not kept; equal rows get equal results; other columns are carried along when asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialweave.llm.text import U64, Words, byte_table, encoded, mix, slices

#: Distinct words whose tokens a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 600_000
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SPACE = byte_table("space", lower=False)
#: White space, and the bytes that continue a code point.
_NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
#: Bytes of code points under U+0340.
_BELOW_GREEK = bytes(range(0xCD))


@dataclass(frozen=True)
class Band:
    """Limits, both ends allowed: characters per token, greatest byte-fallback share, least entropy in bits."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: First code points of the ranges that tell scripts apart, and their names.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x0E00, 0x1100, 0x1200, 0x1E00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "other", "hangul", "other", "latin", "other", "kana", "other", "han", "other", "hangul", "other"]

#: Latin text lies over 1.6 characters a token (3 to 5 in the vocabulary's own languages)
#: with over 5 bits; symbols set between words bring it under 1.5.  Scripts that the
#: vocabulary hardly covers are near one token a character or byte.
BANDS = {
    "latin": Band(1.45, 8.0, 0.10, 4.0),
    "greek": Band(0.6, 8.0, 0.50, 3.0),
    "cyrillic": Band(1.0, 8.0, 0.30, 3.5),
    "hebrew": Band(0.4, 8.0, 0.80, 3.0),
    "arabic": Band(0.4, 8.0, 0.80, 3.0),
    "indic": Band(0.3, 8.0, 0.95, 2.5),
    "hangul": Band(0.3, 8.0, 0.95, 2.5),
    "kana": Band(0.3, 8.0, 0.95, 2.5),
    "han": Band(0.3, 8.0, 0.95, 2.5),
    "other": Band(0.2, 8.0, 1.00, 2.0),
}


def repeated_words(words: Words) -> np.ndarray:
    """Of each text: words inside 3-word windows that occur twice or more in it, the first included."""
    grams = words.grams(3)
    texts = len(words.first) - 1
    owner = np.repeat(np.arange(texts), np.diff(words.first))
    inside = np.zeros(len(owner), np.int64)
    if len(grams):
        whole = np.flatnonzero(owner[: len(grams)] == owner[2 : len(grams) + 2])
        _, place, count = np.unique(mix(grams[whole] + owner[whole].astype(U64) * U64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
        at = whole[count[place] > 1]
        inside[np.concatenate([at, at + 1, at + 2])] = 1
    return np.bincount(owner, inside, texts).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(text: bytes) -> str:
    """Script of most letters beyond ASCII if they outnumber the ASCII letters, else latin."""
    if not text.translate(None, _BELOW_GREEK):
        return "latin"
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    ascii_letters = int((((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)).sum())
    kinds = np.bincount(np.searchsorted(SCRIPT_STARTS, points[points >= 0xC0], "right") - 1, minlength=len(SCRIPT_NAMES))
    totals: dict[str, int] = {"latin": ascii_letters}
    for name, n in zip(SCRIPT_NAMES, kinds.tolist(), strict=True):
        totals[name] = totals.get(name, 0) + n
    return max(totals, key=lambda x: (totals[x], x == "latin"))


class WordPieces:
    """Token ids of distinct words, and which ids are byte fallbacks."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.kind = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.fallback = np.fromiter((self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)), bool, self.size)
        self.table: dict[int, bytes] = {}

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and where each text's tokens begin."""
        distinct, example, place = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.table) > CACHE_WORDS:
            self.table.clear()
        table, names = self.table, distinct.tolist()
        new = [(h, words.buffer[words.start[i] : words.end[i]]) for h, i in zip(names, example.tolist(), strict=True) if h not in table]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.model.encode([w.decode("utf-8", "replace") for _, w in part], num_threads=1)
            flat, pos, wide = np.fromiter((i for ids in found for i in ids), self.kind).tobytes(), 0, self.kind.itemsize
            for (h, _), ids in zip(part, found, strict=True):
                stop = pos + wide * len(ids)
                table[h] = flat[pos:stop]
                pos = stop
        parts = [table[h] for h in names]
        flat = np.frombuffer(b"".join(parts), self.kind)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        begin = np.cumsum(length) - length
        each = length[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(begin[place] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[words.first]


def entropy_bits(ids: np.ndarray) -> float:
    n = len(ids)
    if n < 2:
        return 0.0
    s = np.sort(ids)
    count = np.diff(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])))
    return max(0.0, float(np.log2(n) - (count * np.log2(count)).sum() / n))


_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()),
]
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, base_failed boolean, kept boolean"


def measure(texts: list[bytes], pieces: WordPieces, bands: dict[str, Band]) -> list[tuple]:
    """A row of ``RESULT`` for each text."""
    words = Words(texts, _SPACE)
    repeat = repeated_words(words).tolist()
    ids, begin = pieces.tokens(words)
    fallback = np.concatenate([[0], np.cumsum(pieces.fallback[ids])])
    count = np.diff(words.first).tolist()
    out = []
    for i, text in enumerate(texts):
        n = count[i]
        own = ids[begin[i] : begin[i + 1]]
        tokens = len(own)
        solid = text.translate(None, _NOT_COUNTED)  # one byte of each code point but white space
        plain = len(solid.translate(None, PUNCTUATION))
        per_token = plain / tokens if tokens else 0.0
        share = float(fallback[begin[i + 1]] - fallback[begin[i]]) / tokens if tokens else 0.0
        entropy = entropy_bits(own)
        script = script_of(text)
        failed = n < 50 or 100 * repeat[i] > 50 * n
        b = bands.get(script, bands["other"])
        kept = not failed and b.least_chars <= per_token <= b.most_chars and share <= b.most_fallback and entropy >= b.least_entropy
        out.append((n, len(solid), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeat[i], tokens, per_token, share, entropy, script, failed, kept))
    return out


def quality_rules(docs: DataFrame, vocabulary: str, *, bands: dict[str, Band] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of ``docs`` with the figures and the verdict ``kept``, a row each."""
    bands = bands or BANDS
    columns = list(dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(zip(*measure(encoded(part.column("text")), pieces, bands), strict=True)) or [()] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), *(pa.array(v, kind) for v, (_, kind) in zip(rows, _FIELDS, strict=True))],
                    [*carry, *(n for n, _ in _FIELDS)],
                )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " + RESULT)
