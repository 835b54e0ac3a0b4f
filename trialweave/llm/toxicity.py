"""Toxicity by a lexicon trie crossed with Levenshtein automata, with context windows.

The lexicon is learned from labelled texts: words, and openings of words, whose odds
among toxic texts are surely higher.  ``LexiconAutomaton`` walks the trie and the edit
automaton together; its states are sets of (trie node, edits), made only when first met
and kept, so a word costs a few table lookups and most words leave after three letters.

Each hit weighs by its term and edits and by its context: between quotation marks or after
a word of reporting it counts less.  Sums over the text and over sliding windows of words
go into a logistic regression that gives the score.  The model is fitted in one task on a
bounded, hash-chosen sample.

Defined results: null and empty texts score as texts without hits; equal rows get equal
scores; without both labels in the training rows the score is 0 for all; an empty table
gives an empty one.  Of terms that fit a word equally well the first learned counts.  Ids are
read as long.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import SLICE_BYTES, slices
from trialweave.llm.training import fitted, labelled

#: Most labelled texts used for training (and ``training.TRAIN_BYTES`` of text).
TRAIN_BOUND = 8_000
TOKEN = re.compile(r"[^\W_]+(?:[*@$!|+'’][^\W_]+)*")
#: Digits and signs that stand for letters inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
#: Words of reporting: a hit soon after one of them is likely quoted.
CUES = frozenset("said says say wrote writes called calls quote quoted quotes term word phrase sagte sagt schrieb nannte wort zitat dit disait écrit mot citation dijo dice escribió llamó palabra cita".split())
WINDOW = 40
QUOTED = 0.3
CUE_REACH = 4
_QUOTES = re.compile("[\"“”„«»]")
_DEAD = -1


def allowed(term: str) -> int:
    """Edits allowed for a whole-word term of this length."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """``match(word)`` gives (term number, edits) of the best fitting term, or None.

    Whole-word terms may differ by ``allowed`` edits; openings (``prefix`` true) fit exactly
    and any word may follow from them.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.slack = [0]  # most edits allowed for a term below the node
        for number, (term, prefix) in enumerate(terms):
            room = 0 if prefix else allowed(term)
            node = 0
            self.slack[0] = max(self.slack[0], room)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], room)
            self.ends[node].append(number)
        self.letters = {c for t, _ in terms for c in t}
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.opening: list[int | None] = []
        self.start = self._state({(0, 0)})
        self.openings: dict[str, bool] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        best: dict[int, int] = {}
        while todo:  # a letter of the term may be missing in the word
            node, e = todo.pop()
            if e > self.slack[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo.extend((child, e + 1) for child in self.children[node].values())
        if not best:
            return _DEAD
        key = frozenset(best.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, i) for node, e in key for i in self.ends[node] if not self.terms[i][1] and e <= allowed(self.terms[i][0])]
            self.final.append(min(ends)[::-1] if ends else None)
            heads = [i for node, e in key if e == 0 for i in self.ends[node] if self.terms[i][1]]
            self.opening.append(min(heads) if heads else None)
        return self.known[key]

    def step(self, state: int, c: str) -> int:
        c = c if c in self.letters else ""
        to = self.steps[state].get(c)
        if to is None:
            pairs = set()
            for node, e in self.sets[state]:
                child = self.children[node].get(c)
                if child is not None:
                    pairs.add((child, e))
                if e < self.slack[node]:
                    pairs.add((node, e + 1))
                    pairs.update((x, e + 1) for x in self.children[node].values())
            to = self.steps[state][c] = self._state(pairs)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        state, opening = self.start, None
        if state == _DEAD:
            return None
        for c in word:
            state = self.step(state, c)
            if state == _DEAD:
                return None if opening is None else (opening, 0)
            if opening is None:
                opening = self.opening[state]
        return self.final[state] or (None if opening is None else (opening, 0))

    def may_open(self, head: str) -> bool:
        """Whether a word with this opening can match at all."""
        known = self.openings.get(head)
        if known is None:
            state = self.start
            for c in head:
                if state == _DEAD or self.opening[state] is not None:
                    break
                state = self.step(state, c)
            if len(self.openings) > 200_000:
                self.openings.clear()
            known = self.openings[head] = state != _DEAD
        return known


def plain(word: str) -> str:
    """Word with its stand-in digits and signs undone, if letters are among them."""
    return word if word.isalpha() else word.translate(LEET)


class Matcher:
    """Hits of texts, a word being looked up once per slice."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.automaton = LexiconAutomaton(terms)

    def words(self, texts: list[str]) -> list[set[str]]:
        return [set(TOKEN.findall(t)) if len(t) <= SLICE_BYTES else {m.group() for m in TOKEN.finditer(t)} for t in texts]

    def hits(self, words: Iterable[str]) -> dict[str, tuple[int, int]]:
        a = self.automaton
        out = {}
        for w in words:
            p = w if w.isalpha() else plain(w)
            if a.may_open(p[:3]) and (m := a.match(p)):
                out[w] = m
        return out


FEATURES = 6


def describe(text: str, known: dict[str, tuple[int, int]], weights: list[list[float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Features of a text with hits, and its hits as (start, end, weight in context)."""
    at, spans = [], []
    quotes = [m.start() for m in _QUOTES.finditer(text)]
    q = count = 0
    last_cue = -(10**9)
    quoted = 0.0
    for n, m in enumerate(TOKEN.finditer(text)):
        count, word = n + 1, m.group()
        hit = known.get(word)
        if word in CUES:
            last_cue = n
        if not hit:
            continue
        start = m.start()
        while q < len(quotes) and quotes[q] < start:
            q += 1
        weight = weights[hit[0]][hit[1]]
        if q % 2 and q < len(quotes) or n - last_cue <= CUE_REACH:
            quoted += weight
            weight *= QUOTED
        at.append((n, weight, hit[0]))
        spans.append((start, start + len(word), weight))
    total = sum(w for _, w, _ in at)
    best = run = 0.0
    j = 0
    for n, w, _ in at:
        run += w
        while n - at[j][0] >= WINDOW:
            run -= at[j][1]
            j += 1
        best = max(best, run)
    distinct: dict[int, float] = {}
    for _, w, term in at:
        distinct[term] = max(distinct.get(term, 0.0), w)
    n = max(1, count)
    return [1.0, math.log1p(max(0.0, total)), math.log1p(max(0.0, 100.0 * total / n)), math.log1p(max(0.0, best)), math.log1p(max(0.0, sum(distinct.values()))), math.log1p(quoted)], spans


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]
    weights: list[list[float]]  # per term, by edits
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def score(self, features: list[float]) -> float:
        x = (np.asarray(features) - self.centre) / self.scale
        z = float(self.beta[0] + x @ self.beta[1:])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _surely_higher(a: float, b: float, n_a: int, n_b: int, z: float = 2.6) -> tuple[float, float]:
    """Log odds ratio and its lower bound."""
    ratio = math.log((a + 0.5) / (n_a - a + 0.5)) - math.log((b + 0.5) / (n_b - b + 0.5))
    return ratio, ratio - z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of all texts, each held once, and per text the numbers of its distinct words."""
    matcher, known = Matcher([]), {}
    rows = [np.array([known.setdefault(w, len(known)) for w in matcher.words([t.lower()])[0]], np.int32) for t in texts]
    return list(known), rows


def _one_of_each(words: list[str], rows: list[np.ndarray], labels: list[int]) -> list[int]:
    """Rows without near copies (same label, same two least word hashes): copies would make
    the rare words of one text look telling."""
    import zlib

    codes = np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) for x in words), np.uint64, len(words))
    others = (codes * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    counted = np.fromiter((len(x) > 3 for x in words), bool, len(words))
    seen, out = set(), []
    for i, w in enumerate(rows):
        w = w[counted[w]]
        key = (labels[i], int(codes[w].min()), int(others[w].min())) if len(w) else (labels[i], i, i)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def learn_terms(words: list[str], rows: list[np.ndarray], labels: list[int], most: int = 2_000) -> list[tuple[str, bool]]:
    """Words and word openings that are surely commoner in toxic texts; ``rows`` are numbers of ``words``."""
    n_a = sum(labels)
    n_b = len(labels) - n_a
    telling = np.zeros(len(words), bool)
    for w, y in zip(rows, labels, strict=True):
        if y:
            telling[w] = True
    toxic: dict[tuple[str, bool], int] = {}
    bound: dict[tuple[str, bool], float] = {}
    for size in (None, 5, 6, 7, 8):  # whole words, then openings, of one size at a time
        heads = {}
        for i in np.flatnonzero(telling).tolist():
            if len(words[i]) > (size or 2):
                heads.setdefault(words[i][:size], len(heads))
        at = np.fromiter((heads.get(x[:size], -1) if len(x) > (size or 2) else -1 for x in words), np.int32, len(words))
        count = np.zeros((2, len(heads)), np.int64)
        for w, y in zip(rows, labels, strict=True):
            found = at[w]
            count[1 if y else 0, np.unique(found[found >= 0])] += 1
        names = list(heads)
        for i in np.flatnonzero(count[1] >= 4).tolist():
            a, b = int(count[1, i]), int(count[0, i])
            if _surely_higher(a, 0, n_a, n_b)[1] > 1.0:
                term = names[i], size is not None
                toxic[term], bound[term] = a, _surely_higher(a, b, n_a, n_b)[1]
    order = sorted((t for t in bound if bound[t] > 1.0), key=lambda t: (-bound[t], t[1], t[0]))
    out: list[tuple[str, bool]] = []
    heads: set[str] = set()
    whole = {t[0] for t in order if not t[1]}
    for term, prefix in order:
        if any(term[:k] in heads for k in range(5, 9)):
            continue
        if prefix and any(w.startswith(term) and toxic[(w, False)] >= 0.8 * toxic[(term, True)] for w in whole):
            continue  # one word makes up the opening
        out.append((term, prefix))
        if prefix:
            heads.add(term)
        if len(out) >= most:
            break
    return out


def fit(texts: list[str], labels: list[int]) -> ToxicityModel | None:
    if not texts or len(set(labels)) < 2:
        return None
    words, numbers = numbered(texts)
    rows = _one_of_each(words, numbers, labels)
    some, marks = [numbers[i] for i in rows], [labels[i] for i in rows]
    forms: dict[str, int] = {}
    form = np.fromiter((forms.setdefault(plain(x), len(forms)) for x in words), np.int32, len(words))
    terms = learn_terms(list(forms), [np.unique(form[w]) for w in some], marks)
    hits = Matcher(terms).hits(words)
    matched = np.fromiter((x in hits for x in words), bool, len(words))
    seen = [{words[j]: hits[words[j]] for j in w[matched[w]].tolist()} for w in some]
    n_a, n_b = sum(marks), len(marks) - sum(marks)
    count: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for found, y in zip(seen, marks, strict=True):
        for hit in set(found.values()):
            count[hit][1 - y] += 1
    edited = [sum(n[k] for (_, e), n in count.items() if e) for k in (0, 1)]
    weights = []
    for i, (term, prefix) in enumerate(terms):
        exact = max(0.1, _surely_higher(*count[(i, 0)], n_a, n_b, 1.0)[1])
        row = [exact]
        for e in range(1, 3):
            a, b = count[(i, e)] if (i, e) in count else (0, 0)
            # An unseen misspelling is taken as half as telling as the term, unless misspellings mislead.
            row.append(max(0.0, _surely_higher(a, b, n_a, n_b, 1.0)[1]) if a + b >= 3 else exact * (0.7 if e == 1 else 0.4) * ((edited[0] + 2) / (edited[0] + edited[1] + 2)))
        weights.append(row)
    x, y = [], np.array(marks, float)
    for i, found in zip(rows, seen, strict=True):
        x.append(describe(texts[i].lower(), found, weights)[0] if found else [0.0] * FEATURES)
    x = np.array(x)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 0.05)
    ridge[0] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(terms, weights, centre, scale, beta)


def fit_on(docs: DataFrame, labels: DataFrame, *, bound: int = TRAIN_BOUND) -> ToxicityModel | None:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    return fitted(labelled(docs, some, bound), fit, bound=bound)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, score, n_hits, hits (start, end, weight in context)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model.terms if model else [])
        base = model.score([0.0] * FEATURES) if model else 0.0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(t or "").lower() for t in part.column("text").to_pylist()]
                words = matcher.words(texts) if model else [set()] * len(texts)
                hits = matcher.hits(set().union(*words)) if model else {}
                found = hits.keys()
                scores, spans = [], []
                for text, w in zip(texts, words, strict=True):
                    if found and not w.isdisjoint(found):
                        features, where = describe(text, hits, model.weights)
                        scores.append(model.score(features))
                        spans.append([{"start": a, "end": b, "weight": x} for a, b, x in where])
                    else:
                        scores.append(base)
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(list(map(len, spans)), pa.int64()), pa.array(spans, hit)],
                    ["doc_id", "score", "n_hits", "hits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_hits long, hits array<struct<start:int,end:int,weight:double>>")
