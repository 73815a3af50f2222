"""Character editor: for every character of a scanned word one operation, for every broken line end another.

The operation at a character is written as what comes out for it: the character itself (keep), another
one (replace), nothing (delete), or more than one (insert). An averaged perceptron chooses it from the
characters around it and from what the words of the collection say about the result: the operations offered
are those that lead to a word one misreading away (`Lookup`), and those the inventory of misreadings knows
for the character, whether or not a known word results. At a line end that breaks a word the operations are
joining it without the hyphen and joining it with the hyphen.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import Counter
from math import log2

import numpy as np

from quillgraph.llm.perceptron import Perceptron

# Shapes that scanners are known to read for one another, as (what stood there, what is read).
# They start the inventory; misreadings found in the texts themselves are added to it.
LATIN_CONFUSIONS = [
    ("e", "c"), ("t", "f"), ("i", "l"), ("n", "ri"), ("o", "0"), ("l", "1"), ("u", "ii"), ("s", "5"), ("h", "b"), ("m", "rn"), ("d", "cl"), ("g", "9"),
    ("li", "h"), ("é", "6"), ("w", "vv"), ("ä", "a"), ("rn", "m"), ("cl", "d"), ("T", "F"), ("S", "5"), ("B", "8"), ("O", "0"), ("I", "l"), ("E", "F"),
]
DIGIT_CONFUSIONS = [("1", "l"), ("0", "O"), ("2", "Z"), ("5", "S"), ("8", "B"), ("6", "b")]
CJK_CONFUSIONS = [
    ("量", "童"), ("量", "里"), ("系", "糸"), ("未", "末"), ("问", "间"), ("间", "问"), ("布", "市"), ("论", "沦"), ("荡", "汤"), ("力", "刀"), ("方", "万"), ("概", "慨"),
    ("率", "牢"), ("干", "千"), ("平", "乎"), ("数", "教"), ("阵", "陈"), ("机", "札"), ("折", "拆"), ("实", "买"), ("日", "曰"), ("图", "囹"), ("土", "士"), ("学", "字"), ("已", "己"),
]

IDEOGRAPH = "[\u4e00-\u9fff\u3400-\u4dbf]"
LETTER = r"[^\W_一-鿿㐀-䶿぀-ヿ가-힯]"
#: A word: letters and digits of any alphabet, with a decimal point inside a number.
WORD = re.compile(rf"{LETTER}+(?:(?<=[0-9A-Za-z])\.[0-9A-Za-z]+(?=$|[\s,;)。，]))?")
#: The same with inner hyphens, as words are counted.
HYPHENED = re.compile(rf"{LETTER}+(?:-{LETTER}+)*")
_CJK = re.compile(IDEOGRAPH)
_TRIPLE = re.compile(rf"(?=([^\n]{IDEOGRAPH}[^\n]))")
HYPHENS = "-‐‑¬\xad"


def triples(text: str) -> list[str]:
    """Every ideograph of a text between its neighbours."""
    return _TRIPLE.findall(text) if _CJK.search(text) else []


def triple_counts(texts: list[str]) -> tuple[list[str], list[int]]:
    """The triples of many texts and how often they stand there, by arrays of code points."""
    at = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(at) < 3:
        return [], []
    a, b, c = at[:-2], at[1:-1], at[2:]
    fits = (((b >= 0x4E00) & (b <= 0x9FFF)) | ((b >= 0x3400) & (b <= 0x4DBF))) & (a != 10) & (c != 10)
    keys, n = np.unique(a[fits] << np.uint64(42) | b[fits] << np.uint64(21) | c[fits], return_counts=True)
    low = (1 << 21) - 1
    return [chr(k >> 42) + chr(k >> 21 & low) + chr(k & low) for k in keys.tolist()], n.tolist()


def bucket(n: float, total: float) -> int:
    """Steps of a relative frequency, 0 for none: the same at every size of the collection."""
    return 0 if n <= 0 else 1 + min(14, int(log2(1 + n * 1e6 / max(1.0, total))))


class Inventory:
    """Misreadings: (read, stood) -> support. Segments are of one or two characters, `stood` may be empty."""

    def __init__(self, support: dict[tuple[str, str], float] | None = None):
        self.support = dict(support or {})
        known = max(self.support.values(), default=1.0)
        for stood, read in LATIN_CONFUSIONS + DIGIT_CONFUSIONS + CJK_CONFUSIONS:
            self.support.setdefault((read, stood), 0.05 * known)
        self.by_read: dict[str, list[str]] = {}
        self.free: dict[str, list[str]] = {}
        for read, stood in sorted(self.support):
            if len(read) == len(stood) == 1:
                if _CJK.match(read):
                    self.by_read.setdefault(read, []).append(stood)
                else:
                    # a shape read for a digit can be a digit read for the shape
                    for a, b in ((read, stood), (stood, read)):
                        if a.isdigit() != b.isdigit() and b not in self.free.setdefault(a, []):
                            self.free[a].append(b)
        #: Shape -> the digit it is read for; where it can be several, the better supported.
        self.digit: dict[str, str] = {}
        for a, outs in self.free.items():
            some = [b for b in outs if b.isdigit()]
            if some and not a.isdigit():
                self.digit[a] = max(some, key=lambda b: (self.support.get((a, b), 0.0) + self.support.get((b, a), 0.0), b))
        self.fold = folder(self.support)


def folder(support: dict[tuple[str, str], float]):
    """A function that gives words made from one another by any number of misreadings a key in common.

    Single characters that are read for one another fall into one class, the best supported first; one that
    would join two classes of more than eight members is left out. Two-character shapes are then rewritten
    to the one they stand for until none is left.
    """
    of: dict[str, set[str]] = {}
    for (read, stood), _ in sorted(support.items(), key=lambda x: (-x[1], x[0])):
        if len(read) == len(stood) == 1 and not _CJK.match(read):
            a, b = of.get(read, {read}), of.get(stood, {stood})
            if a is not b and len(a) + len(b) <= 8:
                both = a | b
                of |= dict.fromkeys(both, both)
    rep = {ord(c): min(group) for c, group in of.items()}
    rules = {}
    for read, stood in support:
        long, short = (read, stood) if len(read) > len(stood) else (stood, read)
        if len(long) == 2 and len(short) == 1:
            rules.setdefault(long.translate(rep), short.translate(rep))
    orders = [sorted(rules.items()), sorted(rules.items(), reverse=True)]

    def fold(word: str) -> set[str]:
        # where two rules overlap their order matters, so both orders give a key
        out = set()
        for order in orders:
            w = (word.lower() if word.isupper() and len(word) > 2 else word).translate(rep)
            for _ in range(len(w)):
                before = w
                for long, short in order:
                    w = w.replace(long, short)
                if w == before:
                    break
            out.add(short_key(w))
        return out

    return fold


#: Words up to this length meet by gaps, longer ones by their halves: the same words meet either way.
GAPPED = 26


def gap_keys(word: str, least: int = 4) -> list[str]:
    """Keys of which two words have one in common if they differ in one place by no more than two characters.

    A short word has its forms with a gap for no, one or two characters. A word of many characters would have
    as many keys as characters; where it differs in one place, its first or its second half stands unchanged,
    so it has its halves, for every length its partner can have. Words between have both.
    """
    n, out = len(word), []
    if n <= GAPPED:
        out += [f"{word[:i]}*{word[i + k :]}" for k in (0, 1, 2) if n - k >= least for i in range(n - k + 1)]
    if n > GAPPED - 4:
        for h in sorted({(m - 2) // 2 for m in range(n - 2, n + 3)}):
            out += [f"<{h}{short_key(word[:h])}", f">{h}{short_key(word[n - h :])}"]
    return out


def short_key(text: str) -> str:
    """The text, or a digest of one that is long."""
    return text if len(text) <= 64 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def difference(read: str, stood: str) -> tuple[int, str, str]:
    """(place, read part, stood part) after the common beginning and end."""
    i, most = 0, min(len(read), len(stood))
    while i < most and read[i] == stood[i]:
        i += 1
    j = 0
    while j < most - i and read[-1 - j] == stood[-1 - j]:
        j += 1
    return i, read[i : len(read) - j], stood[i : len(stood) - j]


def _spread(read: str, stood: str) -> list[str]:
    """What comes out for each character of a read segment."""
    out = list(stood[: len(read)]) + [""] * (len(read) - len(stood))
    if len(stood) > len(read):
        out[-1] += stood[len(read) :]
    return out


def outputs(read: str, stood: str, inventory: Inventory) -> list[str] | None:
    """What comes out for each character so that `read` becomes `stood`: the cheapest way through the differing part."""
    if len(read) > 2 and read.isupper() and not stood.isupper():
        stood = stood.upper()
    at, r, s = difference(read, stood)
    if len(r) <= 2 and len(s) <= 2:
        if not r:  # only insertions: at the character before, or at the first
            out = list(read)
            if not read:
                return None
            k = at - 1 if at else 0
            out[k] = out[k] + s if at else s + out[k]
            return out
        return [*read[:at], *_spread(r, s), *read[at + len(r) :]]
    # the cheapest way first, so that only cells near it are looked at, however long the words are
    came: dict[tuple[int, int], tuple] = {}
    heap: list[tuple[float, int, int, tuple | None]] = [(0.0, 0, 0, None)]
    end = len(r), len(s)
    while heap:
        cost, i, j, way = heapq.heappop(heap)
        i, j = -i, -j  # of equal ways the one that is further on
        if (i, j) in came:
            continue
        came[i, j] = way
        if (i, j) == end:
            break
        for a in (1, 2):
            for b in (0, 1, 2):
                x, y = r[i : i + a], s[j : j + b]
                if len(x) == a and len(y) == b and (i + a, j + b) not in came:
                    step = 0.0 if x == y else 1.0 if (x, y) in inventory.support else 1.5 + a + b
                    heapq.heappush(heap, (cost + step, -i - a, -j - b, (i, j, x, y)))
    if end not in came:
        return None
    mid: list[str] = []
    while came[end] is not None:
        i, j, x, y = came[end]
        mid = _spread(x, y) + mid
        end = i, j
    return [*read[:at], *mid, *read[at + len(r) :]]


class Lookup:
    """What the collection says about the words and ideographs of one text.

    words: word -> (count, [(known word, count), ...]); triples: triple -> {ideograph: (count beside its left,
    count beside its right)}. `total` and `pairs` are the sizes the counts are relative to.
    """

    def __init__(self, words: dict, triples: dict, total: float, pairs: float):
        self.words, self.triples, self.total, self.pairs = words, triples, total, pairs

    def own(self, word: str) -> int:
        n = self.words.get(word, (0, ()))[0]
        return n or (self.words.get(word.lower(), (0, ()))[0] if word[:1].isupper() else 0)

    def mates(self, word: str) -> list[tuple[str, int]]:
        got = self.words.get(word)
        out = list(got[1]) if got else []
        low = word.lower()
        if low != word and low in self.words:
            up = str.upper if word.isupper() and len(word) > 1 else str.capitalize
            have = {w for w, _ in out}
            out += [(up(w), n) for w, n in self.words[low][1] if up(w) not in have]
        return out

    def best(self, word: str) -> int:
        return max([self.own(word), *(n for _, n in self.mates(word))])


def _kind(c: str, out: str) -> str:
    return "keep" if c == out else "delete" if not out else "replace" if len(out) == 1 else "insert"


def _class(c: str) -> str:
    if not c:
        return "_"
    return "d" if c.isdigit() else "u" if c.isupper() else "i" if _CJK.match(c) else "l" if c.isalpha() else "." if c in ".,-" else "_"


def _shape(word: str) -> str:
    digits = sum(x.isdigit() for x in word)
    return "n" if digits == len(word.replace(".", "")) else "m" if digits else "1" if len(word) == 1 else "w"


class Editor:
    """The trained operations."""

    def __init__(self, inventory: Inventory, weights: dict[str, float] | None = None):
        self.inventory, self.model = inventory, Perceptron(weights)
        self._most = max(inventory.support.values(), default=1.0)

    def paths(self, word: str, look: Lookup) -> list[tuple[list[str], int, int]]:
        """(outputs, count, edits) of the word itself, of every known word it may be a misreading of, and of the number
        it is if all its letters are digits misread (count -1)."""
        out = [(list(word), look.own(word), 0)]
        for stood, n in look.mates(word):
            o = outputs(word, stood, self.inventory)
            if o is not None and len(o) == len(word):
                out.append((o, n, sum(a != b for a, b in zip(word, o))))
        digit = self.inventory.digit
        if (len(word) < 3 or any(c.isdigit() for c in word)) and all(c.isdigit() or c == "." or c in digit for c in word):
            o = [digit.get(c, c) if not c.isdigit() else c for c in word]
            out.append((o, -1, sum(a != b for a, b in zip(word, o))))
        return out

    def choices(self, word: str, i: int, live: list, ctx: tuple, look: Lookup, done: int) -> dict[str, list[str]]:
        """output -> features, at character i; keep comes first, so ties keep."""
        before, left, right, in_doc, own, shape = ctx
        c = word[i]
        l, r = word[i - 1] if i else left, word[i + 1] if i + 1 < len(word) else right
        lex: dict[str, tuple[int, int]] = {}
        for outs, n, edits in live:
            o = outs[i]
            if o not in lex or (n, -edits) > (lex[o][0], -lex[o][1]):
                lex[o] = (n, edits)
        # where no path keeps the character, keeping it is still a choice
        opts = {c: lex.get(c)} | {o: v for o, v in lex.items() if o != c}
        b_own = bucket(own, look.total)
        rival = max((bucket(v[0], look.total) for o, v in opts.items() if v and o != c), default=0)
        around = _class(l) + _class(r)
        size = min(len(word), 7)
        out = {}
        for o, v in opts.items():
            kind = _kind(c, o)
            b = bucket(v[0], look.total) if v else 0
            lexed = "#" if v and v[0] < 0 else b > 0
            seg = self.inventory.support.get((c, o), 0.0)
            strong = 3 if seg > 0.1 * self._most else 2 if seg > 0.02 * self._most else 1 if seg else 0
            f = [f"{kind}/{shape}/lex{lexed}/own{b_own > 0}", f"{kind}/{shape}/{around}", f"{kind}/len{size}/lex{lexed}", f"{kind}/doc{min(in_doc, 3)}/own{b_own}", f"{c}>{o}", f"{c}>{o}/{around}/{shape}"]
            if kind == "keep":
                f += [f"keep/own{b_own}/rival{rival}/{shape}", f"keep/gain{max(-2, min(8, rival - b_own))}/len{size}", f"keep/{c}/rival{rival > 0}", f"keep/done{min(done, 2)}/lex{b > 0}"]
                if len(word) == 1:
                    f += [f"keep1/{before}", f"keep1/{around}"]
            else:
                edits = v[1] if v else 0
                f += [f"edit/lex{b}{lexed}/own{b_own}/{shape}", f"edit/gain{max(-2, min(8, b - b_own))}/len{size}", f"edit/n{min(edits, 4)}/{shape}/len{size}", f"edit/n{min(edits, 3)}/own{b_own}/lex{lexed}/long{size > 5}", f"edit/inv{strong}/n{min(edits, 3)}/len{size}", f"{l if i else around[0]}{c}>{o}", f"{c}>{o}{r if i + 1 < len(word) else around[1]}", f"edit/num{lexed}/{shape}/{around}"]
                if i in (0, len(word) - 1):
                    f.append(f"edit/end{i == 0}/inv{strong}")
                if len(word) == 1:
                    f += [f"edit1/{before}"]
            out[o] = f
        return out

    def word(self, word: str, before: str, left: str, right: str, in_doc: int, look: Lookup) -> list[str] | None:
        """What comes out for each character, None if all are kept."""
        mates = tuple(look.mates(word))
        key = (word, mates, look.own(word), _class(left), _class(right), min(in_doc, 3), before if len(word) == 1 else "")
        if key in self.model.memo:
            return self.model.memo[key]
        out = self._word(word, before, left, right, in_doc, look)
        if len(self.model.memo) < 200_000:
            self.model.memo[key] = out
        return out

    def _word(self, word: str, before: str, left: str, right: str, in_doc: int, look: Lookup) -> list[str] | None:
        live = self.paths(word, look)
        if len(live) == 1:
            return None
        ctx, out, done = (before, left, right, in_doc, live[0][1], _shape(word)), [], 0
        for i, c in enumerate(word):
            o = c
            if any(p[0][i] != c for p in live):
                opts = self.choices(word, i, live, ctx, look, done)
                names = list(opts)
                o = names[self.model.best([opts[x] for x in names])]
                live = [p for p in live if p[0][i] == o]
            out.append(o)
            done += o != c
        return out if done else None

    def learn_word(self, word: str, truth: list[str], live: list, before: str, left: str, right: str, in_doc: int, look: Lookup) -> None:
        ctx, done = (before, left, right, in_doc, live[0][1], _shape(word)), 0
        for i, o in enumerate(truth):
            if any(p[0][i] != word[i] for p in live):
                opts = self.choices(word, i, live, ctx, look, done)
                if o not in opts:
                    return
                names = list(opts)
                self.model.learn([opts[x] for x in names], names.index(o))
            elif o != word[i]:
                return
            done += o != word[i]
            live = [p for p in live if p[0][i] == o]

    def ideograph(self, triple: str, look: Lookup) -> dict[str, list[str]]:
        """ideograph -> features of keeping the middle of a triple or replacing it."""
        got = look.triples.get(triple)
        c = triple[1]
        if got is None:
            return {c: []}
        step = lambda x: tuple(min(8, bucket(n, look.pairs)) for n in got.get(x, (0, 0)))
        l0, r0 = step(c)
        out = {c: [f"ikeep/{l0}/{r0}", f"ikeep:{c}"]}
        for x in self.inventory.by_read.get(c, ()):
            l1, r1 = step(x)
            out[x] = [f"irep/{l1}/{r1}", f"irep/d{max(-5, min(5, l1 - l0))}/{max(-5, min(5, r1 - r0))}", f"irep:{c}>{x}", f"irep/z{l0 > 0}{r0 > 0}{l1 > 0}{r1 > 0}"]
        return out

    def joins(self, left: str, mark: str, right: str, look: Lookup) -> dict[str, list[str]]:
        """operation -> features at a line end with a hyphen: `drop` joins the word, `hold` joins and keeps the hyphen."""
        whole, hyph = bucket(look.best(left + right), look.total), bucket(look.own(f"{left}-{right}"), look.total)
        l, r = bucket(look.own(left), look.total), bucket(look.own(right), look.total)
        ctx = [f"w{min(whole, 6)}", f"h{min(hyph, 6)}", f"w{whole > 0}/h{hyph > 0}", f"parts{l > 2 and len(left) > 2}/{r > 2 and len(right) > 2}/w{whole > 0}/h{hyph > 0}", f"m{mark}", f"more{whole > hyph}", f"low{right[:1].islower()}"]
        return {op: [f"{op}/{c}" for c in ctx] for op in ("drop", "hold")}

    def join(self, left: str, mark: str, right: str, look: Lookup) -> str:
        opts = self.joins(left, mark, right, look)
        return list(opts)[self.model.best(list(opts.values()))]


def spoil(word: str, inventory: Inventory, rng: random.Random, times: int = 1, digits: bool = False) -> tuple[str, list[str]]:
    """The word with misreadings drawn by their support, and what comes out for each character when they are undone."""
    spots: dict[tuple[int, str, str], float] = {}
    for (read, stood), s in inventory.support.items():
        if stood and not _CJK.match(stood) and (not digits or stood.isdigit()):
            at = word.find(stood)
            while at >= 0:
                spots[at, read, stood] = s
                at = word.find(stood, at + 1)
    if digits:
        for read, out in inventory.free.items():
            for stood in out:
                if stood.isdigit() and not read.isdigit():
                    for at in (m.start() for m in re.finditer(stood, word)):
                        spots.setdefault((at, read, stood), 0.05 * max(inventory.support.values(), default=1.0))
    got: list[tuple[int, str, str]] = []
    pool = dict(spots)
    for _ in range(times):
        if not pool:
            break
        pick = rng.choices(list(pool), list(pool.values()))[0]
        got.append(pick)
        pool = {k: v for k, v in pool.items() if k[0] + len(k[2]) <= pick[0] or k[0] >= pick[0] + len(pick[2])}
    read, outs, at = "", [], 0
    for i, r, s in sorted(got):
        read += word[at:i] + r
        outs += [*word[at:i], *_spread(r, s)]
        at = i + len(s)
    return read + word[at:], outs + list(word[at:])


class Lesson:
    """Training tasks made from clean lines, and what they need to look up."""

    def __init__(self, lines: list[str], inventory: Inventory, seed: int):
        rng = random.Random(seed)
        self.words: list[tuple] = []
        self.chars: list[tuple[str, str]] = []
        self.breaks: list[tuple[str, str, str, str]] = []
        noisy: dict[str, list[str]] = {}
        for read, to in inventory.by_read.items():
            for c in to:
                noisy.setdefault(c, []).append(read)
        for line in lines:
            seen = Counter(WORD.findall(line))
            for m in WORD.finditer(line):
                w = m.group()
                number = w.replace(".", "").isdigit()
                read, truth = w, list(w)
                if rng.random() < (0.25 if number or len(w) > 2 else 0.0):
                    read, truth = spoil(w, inventory, rng, 1 + (rng.random() < 0.2), number)
                hidden = read == w and not number and len(w) > 3 and rng.random() < 0.15
                self.words.append((read, truth, before(line, m.start()), line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1], 1 if read != w else seen[w], hidden))
            for t in triples(line):
                if t[1] in noisy and rng.random() < 0.4:
                    self.chars.append((t[0] + rng.choice(noisy[t[1]]) + t[2], t[1]))
                elif t[1] in inventory.by_read:
                    self.chars.append((t, t[1]))
            for w in HYPHENED.findall(line):
                if len(w) >= 5 and not w[0].isdigit():
                    if "-" in w:
                        left, _, right = w.partition("-")
                        if left and right:
                            self.breaks.append((left, "-", right, "hold"))
                    elif rng.random() < 0.2:
                        at = rng.randint(2, len(w) - 2)
                        left, right = w[:at], w[at:]
                        if rng.random() < 0.1:
                            right = spoil(right, inventory, rng)[0]
                        self.breaks.append((left, rng.choice("---" + HYPHENS), right, "drop"))
        rng.shuffle(self.words)

    def queries(self) -> tuple[set[str], set[str]]:
        """(words, triples) to look up."""
        words = {w for w, *_ in self.words}
        for left, _, right, _ in self.breaks:
            words |= {left, right, left + right, f"{left}-{right}"}
        return words | {w.lower() for w in words}, {t for t, _ in self.chars}

    def train(self, inventory: Inventory, look: Lookup, epochs: int = 2) -> dict[str, float]:
        """Weights of an editor; a hidden word is unknown while it is learned, so that unknown words are kept too."""
        ed = Editor(inventory)
        paths: dict[tuple[str, bool], list] = {}
        for read, _, _, _, _, _, hidden in self.words:
            if (read, hidden) not in paths:
                live = ed.paths(read, look)
                paths[read, hidden] = [(live[0][0], 0, 0), *live[1:]] if hidden else live
        words = [w for w in self.words if len(paths[w[0], w[6]]) > 1]
        for _ in range(epochs):
            for read, truth, bef, left, right, in_doc, hidden in words:
                ed.learn_word(read, truth, paths[read, hidden], bef, left, right, in_doc, look)
            for triple, c in self.chars:
                opts = ed.ideograph(triple, look)
                if len(opts) > 1 and c in opts:
                    ed.model.learn(list(opts.values()), list(opts).index(c))
            for left, mark, right, op in self.breaks:
                opts = ed.joins(left, mark, right, look)
                ed.model.learn(list(opts.values()), list(opts).index(op))
        return ed.model.averaged()


def before(line: str, at: int) -> str:
    """What comes before a token: a word in lower case or the last ideograph."""
    left = line[:at].rstrip()
    if left and _CJK.match(left[-1]):
        return left[-1]
    return left.rsplit(None, 1)[-1].lower() if left else ""
