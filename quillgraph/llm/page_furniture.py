"""Running headers, page numbers and paragraph ends of scanned pages, decided from the place of a line on its page.

An averaged perceptron labels a line `header`, `page_number` or body, and the end of a body line `break`
(a paragraph ends) or `join`. Its features are the line's place: how far it is from the edge of a marked page,
whether its number continues the numbers of the other pages or stands at an even distance from them, whether
the same line stands at other page edges, earlier in the document or at the page edges of many documents, and
what its neighbours are. It is trained on pages set from clean text, whose furniture is known.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from quillgraph.llm.editor import CJK_CONFUSIONS, DIGIT_CONFUSIONS, LATIN_CONFUSIONS
from quillgraph.llm.perceptron import Perceptron

#: The parser's own page marks.
MARK = re.compile(r"^--- 第\d+页(?: ?\(OCR\))? ---\s*$")
_DIGIT_READ = {r: s for s, r in reversed(DIGIT_CONFUSIONS)} | {r: s for s, r in (("1", "I"), ("0", "o"), ("2", "z"), ("5", "s"), ("9", "g"), ("9", "q"))}
_DIGIT = str.maketrans(_DIGIT_READ)
#: A number of more than nine digits counts no pages.
_D = "[0-9" + "".join(_DIGIT_READ) + "]{1,9}"
_DECORATED = re.compile(rf"\[\s?({_D})\s?\]|[-–—]\s({_D})\s[-–—]|[·•]\s({_D})\s[·•]|(?:[Pp][a-z0-9]{{2,3}}|PAGE|Seite|S\.|p\.)\s({_D})|第\s?({_D})\s?[页頁]|({_D})\s/\s{_D}")
_PLAIN = re.compile(_D)
#: No form of a page number is longer than two numbers and what stands between them.
_LONGEST = 21
_ROMAN = re.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_TEXT_NUMBER = [re.compile(rf"^(?P<text>\S.*?\S)\s{{2,}}(?P<n>{_D}|[ivxlc]{{1,12}})$"), re.compile(rf"^(?P<n>{_D}|[ivxlc]{{1,12}})\s{{2,}}(?P<text>\S.*)$")]
_NUMBER_SIGNS = frozenset("0123456789ivxlc") | set(_DIGIT_READ)
_NUMERIC_ROW = re.compile(r"^[\d\s.,;:%+-]+$")
_NUMBERED = re.compile(r"^[\dlIO]+[.．][\dlIO]|^第.{1,3}[章节]")
_HEADING = re.compile(r"^\s*(?:\d{1,2}(?:\.\d{1,2})+\s+[^\W\d]{2}|第.{1,3}[章节])(?!.*[.。，,;；?？!！])")
_ENDED = re.compile(r"[.!?。！？:：;；]['\"”’」』）)]*\s*$")
_HYPHENS = "-‐‑¬\xad"
HYPHEN_END = re.compile(rf"([^\W_]+)[{_HYPHENS}]\s*$")

# Shapes read for one another become one, so that misread lines still compare equal.
_FOLD_MANY = [(r, s) if len(r) > len(s) else (s, r) for s, r in LATIN_CONFUSIONS if len(r) != len(s) and (s, r) not in (("rn", "m"), ("cl", "d"))]
_FOLD_ONE = {"0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "6": "e", "é": "e", "c": "e", "f": "t", "b": "h", "ä": "a"} | {r: min(s for s, x in CJK_CONFUSIONS if x == r) for _, r in CJK_CONFUSIONS if r != "间"} | {"间": "问"}
_LATIN_FOLDS = _FOLD_MANY + [x for x in _FOLD_ONE.items() if ord(x[0]) < 0x2E80]
_CJK_FOLDS = [x for x in _FOLD_ONE.items() if ord(x[0]) >= 0x2E80]


def fold(text: str) -> str:
    """Text without case, blanks and the differences that misreading makes; line ends stay, so lines can be folded together."""
    t = text.casefold()
    for blank in (" ", "　", "\t", "\r", "\f", "\xa0"):
        if blank in t:
            t = t.replace(blank, "")
    for a, b in _LATIN_FOLDS:
        t = t.replace(a, b)
    if not t.isascii():
        for a, b in _CJK_FOLDS:
            t = t.replace(a, b)
    return t


def _roman(t: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    return sum(-v[a] if b and v[b] > v[a] else v[a] for a, b in zip(t, [*t[1:], ""]))


def _values(token: str) -> list[tuple[str, int]]:
    """Readings of a number."""
    out = []
    if (any(ch.isdigit() for ch in token) or len(token) <= 2 and token.translate(_DIGIT).isdigit()):
        out.append(("a", int(token.translate(_DIGIT))))
    if _ROMAN.match(token):
        out.append(("r", _roman(token)))
    return out


def page_number(line: str) -> tuple[bool, list[tuple[str, int]]] | None:
    """(decorated, readings) if the line can be a printed page number and nothing else."""
    s = line.strip()
    if not s or len(s) > _LONGEST:
        return None
    m = _DECORATED.fullmatch(s)
    if m and (v := _values(m[m.lastindex])):
        return True, v
    if _PLAIN.fullmatch(s) and (v := _values(s)):
        return False, v
    if _ROMAN.match(s):
        return False, [("r", _roman(s))]
    return None


def numbered_text(line: str) -> tuple[str, list[tuple[str, int]]] | None:
    """(text, readings) of a line with a page number set apart at one end."""
    s = line.strip()
    if "  " not in s and "\t" not in s:
        return None
    ends = s[:1] in _NUMBER_SIGNS, s[-1:] in _NUMBER_SIGNS
    for form, fits in zip(_TEXT_NUMBER, reversed(ends)):
        m = form.match(s) if fits else None
        if m and sum(ch.isalpha() for ch in m["text"]) >= 2 and (v := _values(m["n"])):
            return m["text"], v
    return None


def _chain(found: list[tuple[int, list[tuple[str, int]]]]) -> tuple[set[int], float]:
    """The longest run of lines whose numbers rise by one a page at an even distance, and that distance."""
    best: set[int] = set()
    gap = 0.0
    by = defaultdict(list)
    for i, vs in found:
        for k, v in vs:
            by[k, v].append(i)
    for i, vs in found:
        if len(best) > 2 and i in best:
            continue
        for k, v in vs:
            for step in (1, 2):
                for j in by.get((k, v + step), ()):
                    per = (j - i) / step
                    if per < 4:
                        continue
                    got = {i, j}
                    for way in (-1, 1):
                        at, miss, n = (i, 0, v) if way < 0 else (j, 0, v + step)
                        while miss < 2:
                            n += way
                            near = [x for x in by.get((k, n), ()) if abs(x - at - way * (miss + 1) * per) <= 6]
                            if near:
                                at = min(near, key=lambda x: abs(x - at - way * (miss + 1) * per))  # noqa: B023
                                got.add(at)
                                miss = 0
                            else:
                                miss += 1
                    if len(got) > len(best):
                        best, gap = got, per
    return best, gap


class Layout:
    """The lines of one text and what their places say."""

    def __init__(self, lines: list[str], notices: frozenset[str] | set[str] = frozenset()):
        self.lines, self.notices = lines, notices
        self._cache: dict[int, tuple[str, str, list[str]]] = {}
        self.marks = {i for i, s in enumerate(lines) if MARK.match(s.strip("\f \r"))}
        self.text = [s.strip(" \t\r\f　") for s in lines]
        self.body = [i for i, s in enumerate(self.text) if s and i not in self.marks]
        self.order = {i: n for n, i in enumerate(self.body)}
        lengths = sorted(len(self.text[i]) for i in self.body)
        self.width = max(1, lengths[int(0.9 * (len(lengths) - 1))]) if lengths else 1
        self.numbers = {i: p for i in self.body if (p := page_number(self.text[i]))}
        self.mixed = {i: p for i in self.body if i not in self.numbers and (p := numbered_text(lines[i].strip("\f")))}
        plain = [i for i in self.body if i not in self.numbers]
        self.key = dict(zip(plain, fold("\n".join(self.mixed[i][0] if i in self.mixed else self.text[i] for i in plain)).split("\n")))
        self.where: dict[str, list[int]] = defaultdict(list)
        for i in self.body:
            if i in self.key:
                self.where[self.key[i]].append(i)
        starts = sorted({0} | {i + 1 for i in self.marks} | {i for i, s in enumerate(lines) if s.startswith("\f")})
        self.paged = len(starts) > 1 or bool(self.marks)
        self.place: dict[int, tuple[int, int]] = {}  # line -> (page, depth from the top 0, 1 or from the bottom -1, -2)
        self.pages: list[list[int]] = []
        self.offset = None
        if self.paged:
            ends = [*starts[1:], len(lines)]
            self.pages = [p for p in ([i for i in self.body if a <= i < b] for a, b in zip(starts, ends)) if p]
            for p, own in enumerate(self.pages):
                for depth in (1, 0):
                    if depth < len(own):
                        self.place[own[-1 - depth]] = (p, -1 - depth)
                        self.place[own[depth]] = (p, depth)
            votes: Counter = Counter()
            for i, (p, _) in self.place.items():
                for k, v in self._read(i):
                    votes[k, v - p] += 1
            top = votes.most_common(1)
            self.offset = top[0][0] if top and (top[0][1] >= 2 or len(self.pages) == 1) else None
        self.chain, self.per = _chain([(i, self._read(i)) for i in sorted([*self.numbers, *self.mixed])])
        # the title: the first line that is neither number nor notice; of two equal lines at the top the second
        first = [i for i in self.body if i not in self.numbers and self.key.get(i) not in notices][:2]
        self.title = first[0] if first else -1
        self.over = -1
        if len(first) == 2 and first[1] - first[0] <= 4 and any(self.key[j] == self.key[first[0]] for j in self.body[:8] if j in self.key and 0 < j - first[0] <= 5):
            self.over, self.title = first
        self.head, self.tail = set(self.body[:3]), set(self.body[-1:])

    def _read(self, i: int) -> list[tuple[str, int]]:
        return self.numbers[i][1] if i in self.numbers else self.mixed[i][1] if i in self.mixed else []

    def candidates(self) -> list[int]:
        """Lines with any sign of furniture: at a page edge, a number, set with a number, seen twice, a notice, first or last."""
        out = set(self.place) | set(self.numbers) | set(self.mixed) | self.head | self.tail
        for k, at in self.where.items():
            if len(at) > 1 or k in self.notices:
                out.update(at)
        return sorted(out)

    def _near(self, i: int) -> tuple[int, int]:
        n = self.order[i]
        return (self.body[n - 1] if n else -1), (self.body[n + 1] if n + 1 < len(self.body) else -1)

    def _flags(self, i: int) -> tuple[str, str, list[str]]:
        """(form, place, signs) of a line, whatever its neighbours are."""
        if i in self._cache:
            return self._cache[i]
        t, a, b = self.text[i], *self._near(i)
        number, mixed = i in self.numbers, i in self.mixed
        form = ("D" if self.numbers[i][0] else "N") if number else "M" if mixed else "T"
        page, depth = self.place.get(i, (-1, 9))
        if self.paged:
            where = f"p{'0' if page == 0 else 'n'}{depth}" if depth != 9 else "inner"
        else:
            where = "u0" if self.order[i] == 0 else "uh" if i in self.head else "ut" if i in self.tail else "u"
        flags = ["single"] if self.paged and len(self.pages) == 1 else []
        vs = self._read(i)
        if vs:
            if self.offset is not None and page >= 0:
                flags.append("fits" if any((k, v - page) == self.offset for k, v in vs) else "unfit")
            flags.append("chain3" if i in self.chain and len(self.chain) > 2 else "chain2" if i in self.chain else "loose" if self.chain else "nochain")
            if any(_NUMERIC_ROW.match(self.text[j]) for j in (a, b) if j >= 0 and abs(j - i) <= 1):
                flags.append("row")
            if number and len(t) > 3 and form == "N":
                flags.append("large")
        if not number:
            k = self.key[i]
            same = [j for j in self.where[k] if j != i]
            if k in self.notices:
                flags.append("notice")
            if i == self.title:
                flags.append("title")
            if i == self.over:
                flags.append("over")
            elif any(j < i and j != self.over for j in same):
                flags.append("earlier")
            if self.title >= 0 and i != self.title and k == self.key[self.title]:
                flags.append("titlekey" if i > self.title else "overkey")
            if self.paged:
                edges = sum(j in self.place for j in same)
                flags += [f"edges{min(edges, 2)}"] if edges else []
                if any(j > i and j not in self.place for j in same):
                    flags.append("laterin")
            elif any(j > i for j in same):
                flags.append("later")
            if _NUMBERED.match(t):
                flags.append("numbered")
            if _ENDED.search(t):
                flags.append("ended")
            # within a sentence: the line before is full and unfinished, the line after goes on
            if a >= 0 and not _ENDED.search(self.text[a]) and len(self.text[a]) > 0.7 * self.width:
                flags.append("cut" if b >= 0 and not self.text[b][:1].isupper() else "halfcut")
            share = len(t) / self.width
            flags.append("full" if share > 0.9 else "wide" if share > 0.7 else "short")
            if a >= 0 and i - a > 1 and i - 1 not in self.marks:
                flags.append("blank")
            if not self.paged and self.per:
                off = [abs((i - j) / self.per - round((i - j) / self.per)) * self.per for j in self.chain if j != i]
                if off and min(off) <= 1.5:
                    flags.append("even")
        self._cache[i] = form, where, flags
        return self._cache[i]

    def features(self, i: int, labels: dict[int, str] | None) -> list[str]:
        """Features of a line; labels are those of an earlier pass, None in the first."""
        return _features(*self._signs(i, labels))

    def _signs(self, i: int, labels: dict[int, str] | None) -> tuple[str, str, tuple[str, ...]]:
        form, where, flags = self._flags(i)
        if labels is None:
            base = "A" + form
        else:
            base, flags = "B" + form, list(flags)
            page, depth = self.place.get(i, (-1, 9))
            for side, j in zip("ab", self._near(i)):
                if j >= 0 and j in labels and abs(j - i) <= 2:
                    flags.append(side + labels[j])
            if depth in (1, -2):
                outer = self.pages[page][0] if depth == 1 else self.pages[page][-1]
                flags.append("outer" if outer in labels else "covered")
            if i not in self.numbers and any(labels.get(j) == "header" for j in self.where[self.key[i]] if j != i):
                flags.append("known")
        return base, where, tuple(flags)

    def label(self, model: Perceptron) -> dict[int, str]:
        """line -> header or page_number, in two passes: the second knows the labels of the first."""
        some = self.candidates()
        first = self._pass(model, some, None)
        return self._pass(model, some, first)

    def _pass(self, model: Perceptron, some: list[int], labels: dict[int, str] | None, learning: bool = False) -> dict[int, str]:
        out = {}
        for i in some:
            signs = self._signs(i, labels)
            yes = model.memo.get(signs)
            if yes is None:
                yes = model.best([[], _features(*signs)])
                if not learning:
                    model.memo[signs] = yes
            if yes:
                out[i] = "page_number" if i in self.numbers else "header"
        return out

    def learn(self, model: Perceptron, truth: dict[int, str], second: bool) -> None:
        some = self.candidates()
        labels = self._pass(model, some, None, True) if second else None
        for i in some:
            model.learn([[], self.features(i, labels)], int(i in truth))

    def ends(self, kinds: dict[int, str]) -> list[tuple[int, int, tuple]]:
        """(line, next body line, signs) of every end of a body line before another one."""
        solid = [i for i in self.body if i not in kinds]
        raw = self.lines
        indent = sum(raw[i].strip("\f").startswith(("　", "  ", "\t")) for i in solid) / max(1, len(solid))
        blanks = 0
        gaps = []
        for a, b in zip(solid, solid[1:]):
            between = range(a + 1, b)
            blank = any(not raw[k].strip() for k in between) and not any(k in kinds or k in self.marks for k in between)
            turned = any(k in kinds or k in self.marks for k in between) or raw[b].startswith("\f")
            blanks += blank
            gaps.append((a, b, blank, turned))
        style = ("I" if indent > 0.03 else "") + ("B" if blanks else "")
        out = []
        for a, b, blank, turned in gaps:
            s, t = self.text[a], raw[b].strip("\f\r")
            share = min(12, int(10 * len(s) / self.width))
            done, hyphen = "." if _ENDED.search(s) else ",", "-" if s[-1] in _HYPHENS else ""
            first = t.strip()[:1]
            start = ("i" if t.startswith(("　", "  ", "\t")) else "") + ("h" if len(t) < self.width and _HEADING.match(t) else "")
            case = "U" if first.isupper() else "d" if first.isdigit() else "o"
            prior = "H" if len(s) < self.width and _HEADING.match(s) else ""
            script = "c" if ord(s[-1]) > 0x2E80 else "l"
            out.append((a, b, (f"end{style}{'b' if blank else ''}{'t' if turned else ''}", done, share, start, hyphen, case, prior, script)))
        return out

    def breaks(self, kinds: dict[int, str], model: Perceptron) -> tuple[list[int], set[int]]:
        """(body lines, those a new paragraph begins after)."""
        out = set()
        for a, _, signs in self.ends(kinds):
            yes = model.memo.get(signs)
            if yes is None:
                yes = model.memo[signs] = model.best([[], _end_features(*signs)])
            if yes:
                out.add(a)
        return [i for i in self.body if i not in kinds], out


def _features(base: str, where: str, flags: tuple[str, ...]) -> list[str]:
    there = base + where
    out = [base, there, there + "&".join(flags)]
    for n, x in enumerate(flags):
        out += [base + x, there + x]
        x = base + x
        out += [x + y for y in flags[n + 1 :]]
    return out


def _end_features(what: str, done: str, share: int, start: str, hyphen: str, case: str, prior: str, script: str) -> list[str]:
    return [what, f"{what}{done}", f"{what}={share}", f"{what}{done}={share}", f"{what}>{start}", f"{what}{hyphen}{script}", f"{what}{done}{case}{script}", f"{what}{prior}", f"{what}{done}={share}{case}", f"end={share}{done}{prior}", f"end>{start}{done}", f"{what}{done}{hyphen}{share >= 8}>{start}{case}{prior}{script}"]


def _misread(line: str, rng: random.Random) -> str:
    pairs = [(s, r) for s, r in LATIN_CONFUSIONS + DIGIT_CONFUSIONS + CJK_CONFUSIONS if s in line]
    if not pairs:
        return line
    s, r = rng.choice(pairs)
    at = rng.choice([m.start() for m in re.finditer(re.escape(s), line)])
    return line[:at] + r + line[at + len(s) :]


def set_pages(paragraphs: list[str], title: str, rng: random.Random) -> tuple[list[str], dict[int, str], set[int], set[str]]:
    """(lines, furniture, lines a paragraph ends at, notices) of a text set on pages the way scans come out.

    Width, indents, blank lines, page length, page marks, the form and place of page numbers and of headers
    (title, section, notice, with or without the number), tables and numbered headings vary by the seed.
    """
    cjk = sum(ord(c) > 0x2E80 for p in paragraphs for c in p) * 3 > sum(map(len, paragraphs))
    width = rng.randint(24, 46) if cjk else rng.randint(45, 90)
    style = rng.choice(("indent", "blank", "plain", "indent" if cjk else "blank"))
    head_blank = rng.random() < 0.6
    glue = "" if cjk else " "
    section = title
    flow: list[tuple[str, str, str]] = []  # (line, end: break or join, section)
    for p in paragraphs:
        if rng.random() < 0.25:  # a heading
            words = re.findall(r"[一-鿿]{2}|[^\W\d_]{4,}", p)[:40]
            name = glue.join(rng.sample(words, min(len(words), 2))) or title
            n = f"{rng.randint(1, 6)}.{rng.randint(1, 9)}"
            kind = rng.random()
            section = f"{n} {name}" if kind < 0.5 else f"第{rng.choice('一二三四五六')}章 {name}" if cjk and kind < 0.8 else name
            if head_blank:
                flow.append(("", "", section))
            flow.append((section, "break", section))
        if rng.random() < 0.06:  # a table of numbers
            for _ in range(rng.randint(1, 4)):
                flow.append(("  ".join(f"{rng.uniform(0, 60):.{rng.randint(0, 1)}f}" for _ in range(rng.randint(1, 4))) if rng.random() < 0.6 else str(rng.randint(1, 2500)), "break", section))
        rest, lines = ("　　" if cjk and style == "indent" else "   " if style == "indent" else "") + p, []
        while len(rest) > width:
            cut = width if cjk else rest.rfind(" ", width // 2, width + 1)
            if not cjk and (cut < 0 or rng.random() < 0.15) and rest[width - 3 : width + 2].isalpha():
                lines.append(rest[: width - 1] + rng.choice(_HYPHENS))
                rest = rest[width - 1 :]
                continue
            cut = cut if cut > 0 else width
            lines.append(rest[:cut])
            rest = rest[cut:].lstrip(" ")
        lines.append(rest)
        flow += [(x, "join", section) for x in lines[:-1]] + [(lines[-1], "break", section)]
        if style == "blank":
            flow.append(("", "", section))
    per, mark = rng.randint(18, 46), rng.choice(("mark", "feed", "none"))
    number = rng.choice(("D", "D", "N", "roman", "none", "none"))
    form = rng.choice(("[{}]", "- {} -", "· {} ·", "Page {}", "第{}页", "{} / 400")) if number == "D" else "{}"
    top_number = rng.random() < 0.4
    head = rng.choice(("none", "running", "running", "notice", "mixed", "title"))
    head_top = rng.random() < 0.75
    notice = rng.choice(("for internal use", "library copy", "内部使用", "扫描副本", "nur zur ansicht", "ne pas vendre"))
    first_head = rng.random() < 0.35
    page, lines, truth, ends = rng.randint(1, 330), [], {}, set()
    if rng.random() < 0.85:
        flow = [(title, "break", title)] + ([("", "", title)] if head_blank else []) + flow
    pad = lambda s: " " * rng.choice((0, 0, 0, 6, 10, 24)) + s
    roman = lambda n: "".join(r * (n // v % (10 if v == 100 else 99)) if v == 100 else "" for v, r in ((100, "c"),)) + ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"][n % 100 // 10] + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]
    if number == "roman":
        page = page % 45 + 1

    def put(line: str, kind: str) -> None:
        if rng.random() < 0.12:
            line = _misread(line, rng)
        truth[len(lines)] = kind
        lines.append(pad(line))

    at, k = 0, 0
    while at < len(flow):
        own = flow[at : at + per]
        at += per
        n = roman(page) if number == "roman" else form.format(page)
        shown = own[0][2] if k % 2 else title
        if head == "title":
            shown = title
        if rng.random() < 0.1:
            shown = shown.upper()
        start = len(lines)
        if mark == "mark":
            lines.append(f"--- 第{k + 1}页 ---")
        upper: list[tuple[str, str]] = []
        lower: list[tuple[str, str]] = []
        if head != "none" and (k or first_head):
            if head == "mixed":
                gap = " " * rng.randint(2, 9)
                (upper if head_top else lower).append((f"{page}{gap}{shown}" if k % 2 == 0 else f"{shown}{gap}{page}", "header"))
            else:
                (upper if head_top else lower).append((notice if head == "notice" else shown, "header"))
        if number != "none" and head != "mixed":
            (upper if top_number else lower).append((n, "page_number"))
        for x in upper:
            put(*x)
        for line, end, _ in own:
            if end == "break":
                ends.add(len(lines))
            lines.append(line if not line or rng.random() > 0.03 else _misread(line, rng))
        for x in lower:
            put(*x)
        if mark == "feed" and k:
            lines[start] = "\f" + lines[start]
        page, k = page + 1, k + 1
    return lines, truth, ends, ({fold(notice)} if rng.random() < 0.8 else set())


def train_layout(texts: list[str], seed: int, pages_of: int = 700, epochs: int = 2) -> dict[str, float]:
    """Weights learned on `pages_of` texts set on pages from the paragraphs of clean ones; without texts none are learned."""
    rng = random.Random(seed)
    paras = [[p.strip() for p in t.split("\n") if len(p.strip()) > 20] for t in texts]
    by_script: dict[bool, list[str]] = {True: [], False: []}
    for ps in paras:
        for p in ps:
            by_script[sum(ord(c) > 0x2E80 for c in p) * 3 > len(p)].append(p)
    layouts = []
    for _ in range(pages_of):
        pool = by_script[rng.random() < 0.55] or by_script[True] or by_script[False]
        if not pool:
            return {}
        some = [rng.choice(pool) for _ in range(rng.choice((1, 2, 3, 4, 6, 10, 16)))]
        words = re.findall(r"[一-鿿]{2}|[^\W\d_]{4,}", some[0]) or [some[0][:8]]
        cjk = ord(words[0][0]) > 0x2E80
        title = ("" if cjk else " ").join(rng.sample(words, min(len(words), 2))) + rng.choice(("讲义", "教程", "") if cjk else (": notes", " workbook", ""))
        lines, truth, ends, notices = set_pages(some, title, rng)
        layouts.append((Layout(lines, notices), truth, ends))
    model = Perceptron()
    for second in (False, True):
        for _ in range(epochs):
            for lay, truth, _ in layouts:
                lay.learn(model, truth, second)
    for _ in range(epochs):
        for lay, truth, ends in layouts:
            for a, _, f in lay.ends(truth):
                model.learn([[], _end_features(*f)], int(a in ends))
    return model.averaged()
