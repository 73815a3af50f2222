"""Headings found in the text alone: broken lines joined, tables of contents left out, lines judged by their form and their
neighbours, titles checked, repeats dropped, ranges and parents derived. One text is read at a time, in order, whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.functions.text import HEADING_FORMS

# Words and patterns that tell headings from other lines.
CONNECTORS = frozenset(
    "and or but of the a an in on at to for with by from into through during this that these those is are was were be been being have has had do does did "
    "will would could should may might must shall can need dare ought used there here where when what which who whom whose why how".split()
)
NO_HEADINGS = frozenset(["review回顾", "review", "last week", "this week", "today", "last talk", "sampling", "contents", "table of contents", "目录", "前言", "preface", "摘要", "abstract"])
TITLE_WORDS = re.compile("总结|结论|引言|前言|背景|方法|实验|结果|讨论|致谢|小结|要点|概览|概述|简介|复习|回顾|展望|附录|说明|介绍|定义|性质|定理|引理|推论|命题|例题|习题|练习|问题|解答|证明|推导|分析|应用|例子|实例|注意事项|重要结论|核心思想|基本思想|主要结论")
BODY_WORDS = re.compile("进行|通过|对于|关于|根据|按照|由于|因为|所以|因此|如果|虽然|但是|然而|不过|即使|除非|一旦|当.*时|随着|使得|导致|引起|产生|形成|发生|出现|存在|包含|包括|组成|构成|分为|属于|具有|需要|要求|必须|应该|可以|能够|主要|通常|一般|往往|常常|经常|比如|例如|也就是|或者说|换句话说|不仅.*而且|既.*又|不是.*而是")
CONTENTS_TITLE = re.compile(r"(?:目\s*录|contents|目次|table of contents)\Z", re.I)
LABELLED = re.compile(r"(?:example|definition|theorem|proposition|corollary|remark|proof|lemma|figure|table)\s*\d*\.?", re.I)
LISTED = re.compile(r"\d+\s*[.．]\s*[\"'`‘’“”一-龥a-zA-Z].+\Z")
SOLUTION = re.compile("参考答案|答案解析|试题解答|解答与评分|评分标准|标准答案")
EXAM_SECTION = re.compile("[一二三四五六七八九十]+\\s*[、．.\\s]+(?:选择|填空|解答|判断|计算|证明|问答|综合|分析|应用|实验|论述|名词解释|简答|多选|单选)(?:题|部分|大题)")
EXPLAINING = re.compile("[A-Za-z]\\s+[^A-Za-z].*(?:解法|答案|解析|分布|密度|期望|方差|概率)")
MATH = re.compile("[∫∬∭∮∯∰∑∏∂∇√∞∈∉∪∩⊂⊃⊆⊇≈≠≡≤≥×÷±αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]")
#: Forms that a numbered line of text can have too, so that their neighbours decide.
UNSURE = frozenset(["numericChapter", "section", "chineseSection", "bracketNumber", "alphaRoman"])
SHORTEST, LONGEST = 4, 120
#: A table of contents ends after so many other lines, or so many lines after its start; what follows closely is left out too.
TOC_GAP, TOC_MOST, TOC_AFTER = 3, 120, 5

_FONT = re.compile(r"\[fs\d+(?:\.\d+)?\]\s*")
_FORMS = [(k, re.compile(p)) for k, p in HEADING_FORMS]
_PAGE = re.compile(r"第\s*[0-9一二三四五六七八九十百千万]+\s*页\Z|[-—–\s]*\d+[-—–\s]*\Z|page\s+\d+\Z|\d+\s*/\s*\d+\Z|.*第\s*\d+\s*页\s*[/／]?\s*共\s*\d+\s*页", re.I)
_TOC = re.compile(r".*\.\s*\.\s*\.\s*\d+\Z|.*[·…]{2,}\s*\d+\Z|.{2,30}[·．.]{3,}\Z|(?:第\s*[一二三四五六七八九十百千万\d]+\s*[章节]?|\d+(?:\.\d+)*)\s*[、．.\s]*\S*[一-龥a-zA-Z].*?\s+\d{1,4}\Z|[一-龥a-zA-Z].+?\s*[.·\-]{2,}\s*\d{1,4}\Z")
_BARE_NUMBER = re.compile(r"(?:第\s*[一二三四五六七八九十百千万\d]+\s*[章节]|\d+(?:\.\d+)+|\d+[.．、])\Z")


def bare(line: str) -> str:
    return _FONT.sub("", line.strip(), count=1).strip()


def is_formula(t: str) -> bool:
    signs, letters = sum(c in "+-*/=<>^~|" for c in t), len(re.findall("[一-龥a-zA-Z0-9]", t))
    words = t.split()
    small = sum(bool(re.match(r"[a-zA-Z]{1,2}[0-9]*\Z", w)) for w in words)
    return bool(t) and bool(MATH.search(t) or letters and signs / (signs + letters) > 0.35 or len(words) > 1 and small >= 0.7 * len(words) or re.search(r"\([^)]*[+\-*/=^][^)]*\)", t) or re.match(r"[\d\s+\-*/=^().]+\Z", t))


def _word(w: str) -> str:
    return re.sub("[^a-z]", "", w.lower())


def is_fragment(t: str) -> bool:
    """English that ends in a connector, so that it goes on in the next line."""
    return bool(re.search("[a-zA-Z]", t)) and bool(t.split()) and _word(t.split()[-1]) in CONNECTORS


def is_plausible(t: str) -> bool:
    """Could be a title: has ideographs, two English words of substance, or is one abbreviation."""
    t = bare(t)
    if len(t) < 2:
        return False
    words = t.split()
    return bool(re.search("[一-龥]", t)) or sum(len(_word(w)) > 1 and _word(w) not in CONNECTORS for w in words) > 1 or len(words) == 1 and bool(re.match("[A-Z]{2,}\\Z", words[0]))


def is_no_heading(t: str) -> bool:
    t = re.sub("[：:]", "", bare(t).lower())
    return t in NO_HEADINGS or bool(t.split()) and all(w in CONNECTORS for w in t.split())


def _is_solution(t: str) -> bool:
    return bool(SOLUTION.search(t)) or t.count("解答") > 1 and bool(re.search("答案|参考|解析|评分", t))


#: Why a title is none, by name: each takes the bare title.
REJECTED = {
    "short": lambda t: len(t) < SHORTEST,
    "contents": lambda t: bool(_TOC.match(t)) or bool(re.match(r"(?:\d+\.?)+\s*[.·\-\s]+\s*\d+\Z", t)),
    "phrase": is_no_heading,
    "solution": _is_solution,
    "label": lambda t: bool(LABELLED.match(t)),
    "list": lambda t: bool(LISTED.match(t)),
    "numbers": lambda t: len(re.findall("[一-龥a-zA-Z]", t)) < max(1, 0.25 * len(re.findall("[一-龥a-zA-Z0-9]", t))),
    "repeats": lambda t: sum(len(m[0]) for m in re.finditer(r"(.)\1{2,}", t)) > 0.4 * len(t),
    "signs": lambda t: len(re.findall("[一-龥a-zA-Z0-9぀-ヿ가-힯]", t)) < 0.5 * len(t),
    "formula": is_formula,
    "numeral": lambda t: bool(re.match(r"\W*(?:[ivx]{1,4}|[a-z])\W*\Z", t, re.I)),
    "fragment": is_fragment,
    "empty": lambda t: len(t) < 6 and len(re.findall("[一-龥a-zA-Z]", t)) < 2,
    "implausible": lambda t: not is_plausible(t),
    "explaining": lambda t: bool(EXPLAINING.match(t)),
}


def rejected(title: str) -> str | None:
    """The first reason why a title is none, None for a good one."""
    t = bare(title)
    return next((name for name, test in REJECTED.items() if test(t)), None)


@dataclass
class Line:
    """A line after joining: its text, where it began in the source, and its font size if it was marked."""

    text: str
    start: int
    size: float | None


def joined_lines(text: str) -> list[Line]:
    """Lines with broken English titles and bare numbers joined to what they belong to."""
    raw, at = [], 0
    for s in text.split("\n"):
        m = _FONT.match(s.strip())
        raw.append(Line(bare(s), at, float(m[0].strip()[3:-1]) if m else None))
        at += len(s) + 1

    def following(i: int) -> int | None:
        return next((j for j in range(i + 1, len(raw)) if raw[j].text), None)

    out, i = [], 0
    while i < len(raw):
        line, end = raw[i], i
        while is_fragment(line.text) and (j := following(end)) is not None and re.search("[a-zA-Z]", raw[j].text) and not is_formula(raw[j].text):
            line, end = Line(f"{line.text} {raw[j].text}", line.start, line.size), j
            if not is_fragment(raw[j].text):
                break
        if _BARE_NUMBER.match(line.text) and (j := following(end)) is not None:
            nxt = raw[j].text
            if not (_PAGE.match(nxt) or is_formula(nxt) or _TOC.match(nxt)):
                line, end = Line(f"{line.text} {nxt}", line.start, line.size or raw[j].size), j
        out.append(line)
        i = end + 1
    return out


def contents_lines(lines: list[Line]) -> set[int]:
    """Lines of tables of contents: after a title of one, or two rows of one, up to three other lines, and some after that."""
    out: set[int] = set()
    row = [bool(_TOC.match(x.text)) for x in lines]
    i = 0
    while i < len(lines):
        titled = bool(CONTENTS_TITLE.match(lines[i].text))
        if not titled and not (row[i] and i + 1 < len(lines) and row[i + 1]):
            i += 1
            continue
        start, others, j = i, 0, i + 1
        while j < len(lines) and j - start <= TOC_MOST:
            t = lines[j].text
            if t:
                others = 0 if row[j] or CONTENTS_TITLE.match(t) else others + 1
                if others >= TOC_GAP or others and lines[j].size:
                    break
            j += 1
        i = min(len(lines), j + TOC_AFTER)
        out.update(range(start, i))
    return out


def line_kind(lines: list[Line], i: int, median: float | None) -> str | None:
    """The kind of heading a line is by its form and its neighbours, None if it is none."""
    t = lines[i].text
    if t.startswith("[bookmark:L"):
        return "bookmark"
    if not SHORTEST <= len(t) <= LONGEST or _PAGE.match(t) or is_formula(t) or _TOC.match(t):
        return None
    a = lines[i - 1].text if i else ""
    b = lines[i + 1].text if i + 1 < len(lines) else ""
    around = (len(a) + len(b)) / 2
    big = lambda times: bool(median and lines[i].size and lines[i].size >= times * median)
    kind = next((k for k, p in _FORMS if p.match(t)), None)
    if kind and (kind not in UNSURE or _stands_out(t, a, b, around, big)):
        return kind
    if re.search("[。！？]", t) or not 6 <= len(t) <= 40:
        return None
    if is_formula(a) or is_formula(b) or LABELLED.match(a) or LABELLED.match(b):
        return None
    fair = around > 3 * len(t) and not is_no_heading(t) and not LISTED.match(t) and not re.match(r"(?:附录|appendix|参考文献|references)\Z", t, re.I)
    return "shortLine" if fair and (big(1.3) or TITLE_WORDS.search(t)) else None


def _stands_out(t: str, a: str, b: str, around: float, big) -> bool:
    """A numbered line is a heading and no sentence or list entry."""
    said = BODY_WORDS.search(t)
    if re.search("[。；！？]", t) or len(t) > 20 and said and said.start() > 3:
        return False
    if 0 < len(a) < 15 and 0 < len(b) < 15 and not big(1.3) and not TITLE_WORDS.search(t):
        return False
    if around > 2 * len(t) or big(1.15) or TITLE_WORDS.search(t):
        return True
    # beside a blank line, unless it is an entry of a glossary: a letter, Latin words, then their translation
    return (not a or not b) and not re.match(r"[A-Z][.．\s]\s*[a-z]{2,}\s*[一-龥]|[A-Z]\s+[a-z]{2,}\s+\w+,?\s*[一-龥]", t)


def level_of(kind: str, mark: str, title: str) -> int:
    fixed = {"chapter": 1, "numericChapter": 1, "sectionZh": 2, "bracketNumber": 4}
    if EXAM_SECTION.match(f"{mark} {title}") or EXAM_SECTION.match(title):
        return 2
    if kind == "markdown":
        return len(mark)
    if kind == "bookmark":
        return min(int(mark) + 1, 6)
    if kind == "section":
        return min(mark.count(".") + 1, 4)
    if kind == "alphaRoman":
        return 2 if re.match("[IVXivx]+\\Z", mark) else 3
    return fixed.get(kind, 3)


def title_key(title: str) -> str:
    t = re.sub(r"^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[0-9]+(?:\.[0-9]+)*)", "", title.lower().strip())
    return re.sub(r"[\s、，,。.：:；;\-—_()（）\[\]【】]", "", t)


def headings_of(text: str) -> list[tuple[int, str, str, int, int, int]]:
    """(level, title, kind, start, end, index of the parent or -1) of the headings of one text, in order."""
    lines = joined_lines(text)
    sizes = sorted(x.size for x in lines if x.size)
    median = sizes[len(sizes) // 2] if sizes else None
    skip, found = contents_lines(lines), []
    for i, x in enumerate(lines):
        kind = None if i in skip else line_kind(lines, i, median)
        if kind is None:
            continue
        m = next((p.match(x.text) for k, p in _FORMS if k == kind), None)
        mark, title = (m[1], m[2].strip()) if m else ("", x.text)
        # a chapter or section number stays part of the title
        shown = title if kind in ("markdown", "bold", "bookmark") else x.text
        if rejected(shown) is None or kind in ("chapter", "sectionZh", "section") and rejected(title) in (None, "short"):
            found.append((level_of(kind, mark, title), shown.strip("* "), kind, x.start))
    marked = [f for f in found if f[2] == "bookmark"]
    found = marked if len(marked) >= 3 else found
    ends = [f[3] for f in found[1:]] + [len(text)]
    best: dict[str, tuple] = {}
    for f, end in zip(found, ends):
        k = title_key(f[1])
        if len(k) > 1 and (k not in best or f[0] > best[k][0]):
            best[k] = (*f, end)
    out, stack = [], []
    for n, f in enumerate(sorted(best.values(), key=lambda f: f[3])):
        while stack and stack[-1][0] >= f[0]:
            stack.pop()
        out.append([*f, stack[-1][1] if stack else -1])
        stack.append((f[0], n))
    for f in reversed(out):  # a parent reaches as far as its children
        if f[5] >= 0:
            out[f[5]][4] = max(out[f[5]][4], f[4])
    return [tuple(f) for f in out]


def outline(documents: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, kind, start_pos, end_pos, parent (ord of it, null at the top) of the headings found in documents
    (doc_id, raw_text). Null and blank texts and null doc_ids have no rows; repeated rows are read each; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in pdf.itertuples(index=False):
                out += [(doc, n, lv, title, kind, a, b, p if p >= 0 else None) for n, (lv, title, kind, a, b, p) in enumerate(headings_of(text))]
            frame = pd.DataFrame(out, columns=["doc_id", "ord", "level", "title", "kind", "start_pos", "end_pos", "parent"])
            frame["parent"] = frame["parent"].astype("Int64")
            yield frame

    return documents.where("doc_id is not null and raw_text <> ''").select("doc_id", "raw_text").mapInPandas(run, "doc_id bigint, ord int, level int, title string, kind string, start_pos bigint, end_pos bigint, parent int")


def with_bookmarks(found: DataFrame, bookmarks: DataFrame, least: int = 3) -> DataFrame:
    """found, but with the bookmarks (same columns) of every document that has fewer than `least` headings at the top."""
    from pyspark.sql import functions as F

    enough = found.where("parent is null").groupBy("doc_id").count().where(F.col("count") >= least).select("doc_id")
    other = bookmarks.join(enough, "doc_id", "left_anti")
    return found.join(other.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(other)
