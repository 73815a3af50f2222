"""Chunks, exam papers and textbook sections: what needs the order of the lines of a text runs in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs of exam papers and their questions; the same patterns work in Java, RE2 and Python.
NUMBERED_LINE = r"^\s*(?:[0-9]+[.．)）]|\([0-9]+\)|（[0-9]+）)\s*"
EXAM_HEADER = r"试卷|考试|课程名称|考试时间|考试方式|密封|得分|评卷人|阅卷人|准考证号|学号|姓名|年级|专业|班级"
EXAM_WORDS = r"选择|填空|解答|判断|证明|计算|得分|满分|共\s*[0-9]+\s*分|每小题|第\s*[0-9]+\s*页\s*共\s*[0-9]+\s*页"
SOLUTIONS = r"参考答案|答案解析|试题解答|解答与评分|评分标准|标准答案"
QUESTION_KINDS = "选择|填空|解答|判断|计算|证明|问答|综合|分析|应用|实验|论述|简答|名词解释"
SECTION_LINE = rf"^\s*(?:第\s*[一二三四五六七八九十]+\s*[章编节部分]|[0-9]+[.．、])\s*(?:{QUESTION_KINDS})(?:题|部分|大题)?"
PAGE_OF = r"第\s*[0-9]+\s*页\s*[/／]?\s*共\s*[0-9]+\s*页"

#: Lines that never belong into a chunk, by name.
_DROPPED = {
    "page mark": re.compile(r"---\s*第\d+页\s*---"),
    "page number": re.compile(r"\d{1,3}\Z"),
    "leader": re.compile(r"\.{2,}\s*\Z|.*\.{5}"),
    "formula": re.compile(r"[∫∬∭∮∯∰∑∏∂∇√∞∈∉∪∩⊂⊃⊆⊇]|[\d\s+\-*=<>^~∫∬∭∮∯∰∑∏∂∇√∞αβγδεζηθικλμνξοπρστυφχψω]+\Z"),
}
_CONTENTS_ROW = re.compile(r"\d+(?:\.\d+)*\s+\S.*\s+\d+\Z")
_FONT = re.compile(r"\[fs\d+\.?\d*\]")
_NUMBERED_START = re.compile(r"\d+(?:\.\d+)*\s")


def _clean(text: str) -> str:
    """Lines worth keeping: no page marks and numbers, rows of a table of contents and what follows them up to the next
    line of text, leaders and formulas; marked headings always stay, blank lines too."""
    kept, in_contents = [], False
    for line in text.split("\n"):
        t = line.strip()
        if t and not _FONT.match(t):
            if _CONTENTS_ROW.match(t) and not _DROPPED["page mark"].match(t):
                in_contents = True
                continue
            if any(p.match(t) for p in _DROPPED.values()):
                continue
            in_contents = in_contents and not (len(t) > 20 and not _NUMBERED_START.match(t))
            if in_contents:
                continue
        kept.append(t if t == "" or _FONT.match(t) else line)
    return "\n".join(kept)


def pack(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs of a cleaned text packed into chunks of at most `size`; a chunk begins with the end of the one before, from
    the first line end within the last `overlap` characters; what is still too long is cut hard."""
    text = _clean(text)
    if not text.strip():
        return []
    if len(text) <= size:
        return [text.strip()]
    whole: list[str] = []
    held = ""
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text))):
        if held and len(held) + len(p) + 2 > size:
            if held.strip():
                whole.append(held.strip())
            held = ""
            if overlap > 0 and whole:
                last = whole[-1]
                cut = max(0, len(last) - overlap)
                line = last.find("\n", cut)
                tail = last[cut if line < 0 else line + 1 :].strip()
                held = tail + "\n\n" if tail else ""
        held += ("\n\n" if held else "") + p
    if held.strip():
        whole.append(held.strip())
    out: list[str] = []
    for c in whole:
        step = size if len(c) <= size else max(1, size - overlap)
        out += [c[i : i + size].strip() for i in range(0, len(c), step)]
    return [c for c in out if c]


def cleaned(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(_clean, na_action="ignore"), "string")(c)


def overlapping(c: Column, size: int, overlap: int) -> Column:
    """array of chunks of pack(); a blank text has none, null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda t: pack(t, size, overlap), na_action="ignore"), "array<string>")(c)


def by_headings(documents: DataFrame, headings: DataFrame, size: int, overlap: int, least: int = 3) -> DataFrame:
    """doc_id, ord, chunk of documents (doc_id, raw_text): one block from each heading to the next, blocks that are too long
    packed under their first line, marked as continued; with fewer than `least` headings the text is packed whole."""
    starts = headings.where("start_pos >= 0 and doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("start_pos")).alias("starts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, at in pdf.itertuples(index=False):
                at = [int(a) for a in at if a < len(text)] if at is not None else []
                pieces: list[str] = []
                if len(at) < least:
                    pieces = pack(text, size, overlap)
                else:
                    for a, b in zip([0, *at] if at[0] else at, [*at, len(text)] if at[0] else [*at[1:], len(text)]):
                        block = text[a:b].strip()
                        if len(block) <= size:
                            pieces += [block] if block else []
                            continue
                        first = block.split("\n", 1)[0]
                        sub = pack(block, size, overlap)
                        pieces += [s if k == 0 else f"{first}（续）\n{s}" for k, s in enumerate(sub)]
                out += [(doc, k, p) for k, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["doc_id", "ord", "chunk"])

    d = documents.where("doc_id is not null and raw_text is not null").join(starts, "doc_id", "left")
    return d.select("doc_id", "raw_text", "starts").mapInPandas(run, "doc_id bigint, ord int, chunk string")


def is_exam_paper(c: Column) -> Column:
    """An exam paper by its head and two numbered lines, or by three numbered lines and words of exams, in the first 6000
    characters; texts below 200 characters are none. Null: false."""
    head = F.substring(c, 1, 6000)
    n = F.size(F.filter(F.split(head, "\n"), lambda s: s.rlike(NUMBERED_LINE)))
    return F.coalesce((F.length(c) >= 200) & ((head.rlike(EXAM_HEADER) & (n >= 2)) | ((n >= 3) & head.rlike(EXAM_WORDS))), F.lit(False))


def _questions(text: str) -> list[tuple[str, str]]:
    """(section, question) up to the solutions; lines without a number go to the question before."""
    found = re.search(SOLUTIONS, text)
    section, out, open_ = "正文", [], False
    for t in filter(None, map(str.strip, text[: found.start() if found and found.start() else None].split("\n"))):
        if re.match(SECTION_LINE, t):
            section, open_ = t, False
        elif re.search(PAGE_OF, t) or t.isdecimal():
            continue
        elif m := re.match(NUMBERED_LINE, t):
            out.append((section, t[m.end() :].strip()))
            open_ = True
        elif open_:
            out[-1] = section, f"{out[-1][1]}\n{t}"
    return out


def exam_questions(documents: DataFrame) -> DataFrame:
    """doc_id, ord, section, question of the exam papers among documents (doc_id, text)."""
    kind = "array<struct<section:string,question:string>>"
    q = F.pandas_udf(lambda s: s.map(_questions), kind)(F.col("text"))
    return documents.where(is_exam_paper(F.col("text"))).select("doc_id", F.posexplode(q).alias("ord", "q")).select("doc_id", "ord", "q.section", "q.question")


_CHAPTER = re.compile(r"第\s*(\d+)\s*章")
_SECTION = re.compile(r"(\d+\.\d+)\s*([^\n]+)")


def _book(text: str, most: int = 50) -> list[tuple[str, str, str]]:
    """(chapter, title, content): chapters at their marks, sections at X.Y numbers within them; a chapter without sections is
    one, and a text without chapters its first `most` paragraphs."""
    marks = list(_CHAPTER.finditer(text))
    if not marks:
        return [(str(k + 1), "", p) for k, p in enumerate([p for p in re.split(r"\n\s*\n", text) if len(p.strip()) > 30][:most])]
    out = []
    for m, end in zip(marks, [x.start() for x in marks[1:]] + [len(text)]):
        body, some = text[m.start() : end], False
        secs = list(_SECTION.finditer(body))
        for s, stop in zip(secs, [x.start() for x in secs[1:]] + [len(body)]):
            content = body[s.end() : stop].strip()
            if len(content) > 20:
                out.append((m[1], f"{s[1]} {s[2].strip()}", content))
                some = True
        if not some and len(body) > 50:
            out.append((m[1], body[m.end() - m.start() :].split("\n", 1)[0].strip() or f"第{m[1]}章", body))
    return out


def textbook_sections(documents: DataFrame) -> DataFrame:
    """doc_id, ord, chapter, title, content of documents (doc_id, text) by chapter and section numbers alone."""
    kind = "array<struct<chapter:string,title:string,content:string>>"
    s = F.pandas_udf(lambda x: x.map(_book), kind)(F.col("text"))
    return documents.where("text is not null").select("doc_id", F.posexplode(s).alias("ord", "s")).select("doc_id", "ord", "s.chapter", "s.title", "s.content")


def context_lines(documents: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """heading_id, line_no, n_lines, digest: the line a point (heading_id, doc_id, start_pos) lies in and the digest of the lines
    around it, `radius` on each side. Texts are read once a document, with the points of it."""
    at = points.where("doc_id is not null and start_pos >= 0").groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "heading_id")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from bisect import bisect_right

        for pdf in batches:
            out = []
            for text, at in pdf.itertuples(index=False):
                lines = text.split("\n")
                starts = [0]
                for s in lines[:-1]:
                    starts.append(starts[-1] + len(s) + 1)
                for p in at:
                    k = bisect_right(starts, p["start_pos"]) - 1
                    some = lines[max(0, k - radius) : k + radius + 1]
                    out.append((p["heading_id"], k, len(some), hashlib.md5("\n".join(some).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["heading_id", "line_no", "n_lines", "digest"])

    return documents.join(at, "doc_id").select("raw_text", "at").mapInPandas(run, "heading_id string, line_no int, n_lines int, digest string")


def content_or_sections(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, content: raw_text, or where that is null or empty the sections (doc_id, ord, heading_id, title, content) in order
    as `## title` and content, or an empty text."""
    one = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    s = sections.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading_id", one.alias("c")))), lambda x: x["c"]), "\n").alias("s"))
    return documents.join(s, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("raw_text") != "", F.col("raw_text")), "s", F.lit("")).alias("content"))
