"""What the graph of a document needs of its text, read in one pass where the document lies: counts of its tokens, then its
entities, the headings around them, the relations between them and the sentences they share."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from math import log

import numpy as np
import pyarrow as pa

from quillgraph.functions.lists import flat, lists
from quillgraph.functions.tokens import SENTENCE_ENDS
from quillgraph.operators.graph import RELATION_FORMS

COUNTS = "doc_id bigint, token string, tf int, first_pos int"
#: a and b are places in names.
READ = "doc_id bigint, ids array<string>, names array<string>, totals array<double>, held array<string>, rel_a array<int>, rel_b array<int>, rel_kind array<string>, rel_weight array<double>, co_a array<int>, co_b array<int>, co_n array<int>"
#: text.WS, and what Java's dot matches in a clause.
_WS = " \t\n\x0b\f\r\x85\xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
_DOT = r"[^。；;\n\r\x85  ]"
#: What follows the first end of a form, which is cheap to seek and there wherever the form is; the form; its ends.
_FORMS = [(re.compile(q[q.index(")") + 1 :]), re.compile(q), ends) for q, ends in ((p.replace(".+", _DOT + "+"), ends) for p, ends in RELATION_FORMS)]
_SENTENCE = re.compile(f"[{SENTENCE_ENDS}]")
_IDEOGRAPHS = re.compile("[一-龥]+")


def _tokens(match: str, terms: set[str]) -> list[str]:
    """tokens.dict_tokens() of one of its matches, without pairs of ideographs that are no terms."""
    if match in terms:
        return [match]
    if "一" <= match[:1] <= "龥":
        return [g for g in map("".join, zip(match, match[1:])) if g in terms] if len(match) >= 4 else []
    return [match.lower()] if len(match) > 1 else []


def counted(batches: Iterator[pa.RecordBatch], terms: set[str]) -> Iterator[pa.RecordBatch]:
    """COUNTS of (doc_id, matches): terms and words of every row, numbered in their order; no pairs of ideographs but terms."""
    for b in (x.slice(lo, 1000) for x in batches for lo in range(0, len(x), 1000)):
        row, found = flat(b.column(1))
        d = found.dictionary_encode()
        parts = [_tokens(m, terms) for m in d.dictionary.to_pylist()]
        words = list(dict.fromkeys(t for p in parts for t in p))
        code = {t: k for k, t in enumerate(words)}
        size = np.array([len(p) for p in parts], "int64")
        start, all_ = np.cumsum(size) - size, np.array([code[t] for p in parts for t in p], "int64")
        at = d.indices.to_numpy().astype("int64")
        n = size[at]
        row = np.repeat(row, n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        tok = all_[np.repeat(start[at], n) + inner] if len(row) else np.zeros(0, "int64")
        key, first, tf = np.unique(row * max(1, len(words)) + tok, return_index=True, return_counts=True)
        first -= np.searchsorted(row, np.arange(len(b)))[key // max(1, len(words))]
        row, tok = key // max(1, len(words)), key % max(1, len(words))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(words, pa.string()).take(pa.array(tok)), pa.array(tf.astype("int32")), pa.array(first.astype("int32"))], ["doc_id", "token", "tf", "first_pos"])


def paragraphs(t: str) -> list[str]:
    """tokens.paragraphs() of one text."""
    keep = lambda p: [s for s in (x.strip(_WS) for x in re.split(p, t)) if len(s) > 30]
    some = keep(r"\n[ \t\n\x0b\f\r]*\n+")
    some = some if len(some) >= 3 else keep(r"\n+")
    return some or [x for x in [t.strip(_WS)] if x]


def _deepest(points: list[int], heads: list[tuple]) -> dict[int, str]:
    """graph.heading_at() of one document; heads are (start, end, level, id)."""
    out, still, heads, k = {}, [], sorted(heads, key=lambda h: h[0]), 0
    for pos in points:
        while k < len(heads) and heads[k][0] <= pos:
            start, end, level, key = heads[k]
            still.append((-1 if level is None else level, start, key, end))
            k += 1
        still = [x for x in still if x[3] > pos]
        if still:
            out[pos] = max(still)[2]
    return out


def _around(names: list[str], raws: list[str], heads: list[tuple], most: int) -> list[str | None]:
    """The heading around the first of an entity's first `most` occurrences that lies in any."""
    if not heads or not raws:
        return [None] * len(names)
    bounds = sorted({p for h in heads for p in h[:2]})
    deepest = _deepest(bounds, heads)  # the same from one bound to the next
    inside = [deepest.get(p) for p in bounds]

    def first(raw: str, what: str) -> tuple[int, str] | None:
        at = raw.find(what)
        for _ in range(most):
            if at < 0:
                return None
            k = bisect_right(bounds, at) - 1
            if k >= 0 and inside[k] is not None:
                return at, inside[k]
            at = raw.find(what, at + len(what))

    best = (min((hit for raw in raws if (hit := first(raw, x))), default=None) for x in names)
    return [x and x[1] for x in best]


def _relations(texts: list[str], place: dict[str, int]) -> dict[tuple[int, int, str], float]:
    """graph.pattern_relations() of the clauses of one document, where both ends are entities."""
    out: dict[tuple[int, int, str], float] = {}
    if sum(bool(_IDEOGRAPHS.fullmatch(x)) for x in place) < 2:
        return out
    for t in texts:
        live = [f for f in _FORMS if f[0].search(t)]
        for c, (rest, form, ends) in ((c, f) for c in (re.split("[。；;]", t) if live else []) if len(c) >= 10 for f in live):
            m = rest.search(c) and form.search(c)
            for a, b, kind, weight in ends if m else []:
                a, b = place.get(m[a]), place.get(m[b])
                if a is not None and b is not None and a != b:
                    out[a, b, kind] = max(weight, out.get((a, b, kind), 0.0))
    return out


class Matches:
    """The matches of a batch, each once."""

    def __init__(self, words: list[str], terms: set[str], pairs: set[str]):
        """pairs: the terms that are two ideographs."""
        self.code = {w: k for k, w in enumerate(words)}
        self.grams = {k: g for k, w in enumerate(words) if len(w) >= 4 and "一" <= w[0] <= "龥" and w not in terms and (g := _tokens(w, terms))} if pairs else {}
        self.has_grams = np.zeros(len(words), bool)
        self.has_grams[list(self.grams)] = True
        self.ends = np.array([len(w) == 1 and w in SENTENCE_ENDS for w in words], bool)
        self.place = np.full(len(words), -1, "int64")

    def units(self, low: str, codes: np.ndarray, place: dict[str, int]) -> np.ndarray:
        """Which entities every sentence holds: a row each."""
        pieces = np.array([len(s.strip(_WS)) >= 8 for s in _SENTENCE.split(low)])
        mine = [(self.code[x], k) for x, k in place.items() if x in self.code]
        self.place[[c for c, _ in mine]] = [k for _, k in mine]
        got, unit = self.place[codes], np.cumsum(self.ends[codes])
        self.place[[c for c, _ in mine]] = -1
        out = np.zeros((len(pieces), len(place)), bool)
        at = np.flatnonzero(got >= 0)
        out[unit[at], got[at]] = True
        for p in np.flatnonzero(self.has_grams[codes]).tolist() if self.grams else []:
            for g in self.grams[int(codes[p])]:
                if g in place:
                    out[unit[p], place[g]] = True
        return out[pieces]


def _pairs(units: list[np.ndarray], of_unit: int) -> tuple[np.ndarray, ...]:
    """a, b, n: entities a < b that share n sentences; the first `of_unit` of each count. Texts of one document share their sentences' numbers."""
    m = np.zeros((max(map(len, units)), units[0].shape[1]), bool)
    for u in units:
        m[: len(u)] |= u
    m &= np.cumsum(m, axis=1, dtype="int32") <= of_unit
    m = m.astype("int32")  # no floats: a library with threads of its own would multiply those
    n = np.triu(m.T @ m, 1)
    a, b = np.nonzero(n)
    return a, b, n[a, b]


def _document(doc: int, words: list[tuple], heads: list[tuple], texts: list[tuple], candidates: int, top: int, occurrences: int, of_unit: int) -> tuple | None:
    if len(words) > candidates:
        words = sorted(words, key=lambda w: (-round(w[1], 9), w[2], w[0]))[:candidates]
    parts = [p for low, *_ in texts for p in paragraphs(low)]
    total = [(w, t) for w, x, _, bad in words if not bad and (n := [w in p for p in parts].count(True)) and (t := x * (1 + log(n + 1.0))) > 0]
    if len(total) > top:
        total = sorted(total, key=lambda e: (-round(e[1], 9), e[0]))[:top]
    if not total:
        return None
    total.sort(key=lambda e: (-len(e[0]), e[0]))  # the longest first: of a sentence with many the first count
    names = [w for w, _ in total]
    place = {w: k for k, w in enumerate(names)}
    rel = _relations([low for low, *_ in texts], place)
    both = _pairs([known.units(low, codes, place) for low, _, codes, known in texts], of_unit)
    held = _around(names, [raw for _, raw, *_ in texts if raw is not None], heads, occurrences)
    return doc, names, [t for _, t in total], held, rel, both


def _rows(docs: list[tuple]) -> pa.RecordBatch:
    ints, cols = pa.int32(), [pa.array([d[0] for d in docs], pa.int64())]

    def column(of: list[list], kind: pa.DataType) -> None:
        cols.append(lists(np.array([len(x) for x in of], "int64"), pa.array([v for x in of for v in x], kind)))

    column([[f"e_{d[0]}_{sha256(x.encode()).hexdigest()[:16]}" for x in d[1]] for d in docs], pa.string())
    for k, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.string())):
        column([d[k] for d in docs], kind)
    for k, kind in ((0, ints), (1, ints), (2, pa.string())):
        column([[r[k] for r in d[4]] for d in docs], kind)
    column([list(d[4].values()) for d in docs], pa.float64())
    for k in range(3):
        cols.append(lists(np.array([len(d[5][k]) for d in docs], "int64"), pa.array(np.concatenate([d[5][k] for d in docs]).astype("int32"))))
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in READ.split(", ")])


def read(batches: Iterator[pa.RecordBatch], terms: set[str], **limits: int) -> Iterator[pa.RecordBatch]:
    """READ of rows that come document by document: its words (kind 0: s, x score, i first position, lv rubbish), its headings
    (kind 1: s id, i start, j end, lv level) and its texts (kind 2: low, raw in lower case, found tokens.sentence_matches())."""
    pairs = {t for t in terms if len(t) == 2}
    doc, words, heads, texts, done = None, [], [], [], []

    def end() -> None:
        if words and texts and (out := _document(doc, words, heads, texts, **limits)):
            done.append(out)

    def numbers(c: pa.Array) -> list:
        return c.fill_null(0).to_numpy(zero_copy_only=False).tolist()

    for b in batches:
        row, found = flat(b.column("found"))
        d = found.dictionary_encode()
        known, codes = Matches(d.dictionary.to_pylist(), terms, pairs), d.indices.to_numpy()
        upto = np.searchsorted(row, np.arange(len(b) + 1))
        kinds, has_level = numbers(b.column("kind")), b.column("lv").is_valid().to_numpy(zero_copy_only=False)
        for k, (i, kind, s, x, p, q, lv) in enumerate(zip(numbers(b.column("doc_id")), kinds, b.column("s").to_numpy(zero_copy_only=False).tolist(), *(numbers(b.column(c)) for c in ("x", "i", "j", "lv")))):
            if i != doc:
                end()
                doc, words, heads, texts = i, [], [], []
            if kind == 0:
                words.append((s, x, p, lv))
            elif kind == 1:
                heads.append((p, q, lv if has_level[k] else None, s))
            else:
                texts.append((b.column("low")[k].as_py(), b.column("raw")[k].as_py(), codes[upto[k] : upto[k + 1]], known))
        if len(done) >= 100:
            yield _rows(done)
            done.clear()
    end()
    if done:
        yield _rows(done)
