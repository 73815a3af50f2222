"""Text-cleaning scalars as Column functions: all stay inside generated code.

Offsets and lengths count code points. A null input gives null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of any kind; the same class works in Java and in RE2.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Ideographs the tokenizers know.
CJK = "[一-龥]"
PAGE_MARK = r"--- 第(\d+)页(?: ?\(OCR\))? ---"

# Endings of file names and what they stand for.
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
TYPE_ENDINGS = {"pdf": ["pdf"], "docx": ["docx"], "pptx": ["pptx"], "unsupported": ["doc", "ppt"], "image": list(IMAGE_MIME), "markdown": ["md", "markdown"], "code": ["js", "py", "ts"]}
BLOCK_END = r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def unicode_lower_trim(c: Column) -> Column:
    return trim_ws(F.lower(c))


def file_ending(name: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"\.([a-z0-9]+)$", 1)


def detect_type(name: Column) -> Column:
    """Document type by file name; old binary formats are `unsupported`, anything unknown and null is `text`."""
    ext, out = file_ending(name), F.lit("text")
    for kind, endings in TYPE_ENDINGS.items():
        out = F.when(ext.isin(endings), kind).otherwise(out)
    return out


def mime_type(name: Column) -> Column:
    ext, out = file_ending(name), F.lit("image/png")
    for ending, mime in IMAGE_MIME.items():
        out = F.when(ext == ending, mime).otherwise(out)
    return out


def strip_marks(c: Column) -> Column:
    """Without the parser's font and bookmark marks."""
    return F.regexp_replace(c, r"\[fs\d+(?:\.\d+)?\]|\[bookmark:L\d+\]", "")


def strip_font_mark(c: Column) -> Column:
    """A line without the font mark it begins with; bookmark marks stay."""
    return F.regexp_replace(c, rf"^{WS}*\[fs\d+(?:\.\d+)?\]{WS}*", "")


def line_starts(c: Column) -> Column:
    """Offset of the first character of every line that has one; prefix sums of a long text need one pass, hence Python."""
    starts = lambda t: [m.start() for m in re.finditer(r"(?<![^\n])[^\n]", t)]
    return F.pandas_udf(lambda s: s.map(starts, na_action="ignore"), "array<bigint>")(c)


def escape_html(c: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;")) if quotes else out


def text_to_html(c: Column) -> Column:
    """Paragraphs, split at blank lines, escaped and wrapped; blank ones are dropped."""
    paras = F.filter(F.split(c, r"\n\s*\n+"), lambda p: p.rlike(r"\S"))
    return F.array_join(F.transform(paras, lambda p: F.concat(F.lit("<p>"), F.replace(escape_html(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def html_to_text(c: Column) -> Column:
    """Block ends become line ends, other tags go, the six common entities are decoded, blank lines collapse to one."""
    out = F.regexp_replace(F.regexp_replace(c, BLOCK_END, "\n"), r"<[^>]+>", "")
    for entity, ch in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def decode_xml_entities(c: Column) -> Column:
    for entity, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return c


def decode_base64_text(c: Column) -> Column:
    """Text that is base64 (its alphabet only, not blank, whole groups) is decoded as UTF-8; other text is kept."""
    flat = F.regexp_replace(c, r"\s", "")
    ok = c.rlike(r"^[A-Za-z0-9+/=\s]+$") & (F.length(flat) > 0) & (F.length(flat) % 4 == 0) & flat.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    return F.when(ok, F.decode(F.unbase64(F.when(ok, flat)), "UTF-8")).otherwise(c)


_HIGH = re.compile("[\x80-\xff]")
_HIGH_RUN = re.compile("[\x80-\xff]{2,}")


def _read_again(text: str) -> str:
    def run(m: re.Match) -> str:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    high = len(_HIGH.findall(text))
    if high < 3:
        return text
    again = _HIGH_RUN.sub(run, text)
    return again if len(_HIGH.findall(again)) < 0.5 * high else text


def fix_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again run by run, if at least three characters are between U+0080 and U+00FF and
    reading again leaves less than half as many; what is beyond, and runs that are no UTF-8, stay as they are."""
    return F.pandas_udf(lambda s: s.map(_read_again, na_action="ignore"), "string")(c)


def fold_ghosts(c: Column, passes: int = 5) -> Column:
    """Characters and phrases doubled by overprinting: an ideograph three or more times, a Latin word of three or more letters
    twice, an ideographic phrase four or more times in a row become one; again for what the folding brings together."""
    for _ in range(passes):
        c = F.regexp_replace(c, r"([一-龥])\1{2,}", "$1")
        c = F.regexp_replace(c, r"([a-zA-Z]{3,})\1", "$1")
        c = F.regexp_replace(c, r"([一-龥]{2,}?)\1{3,}", "$1")
    return c


def link_form(c: Column) -> Column:
    """For linking: lower case, without blanks, separators and a leading chapter or number."""
    flat = F.regexp_replace(F.lower(c), rf"{WS}|[\-_.，,、]", "")
    return F.regexp_replace(flat, r"^(?:第[一二三四五六七八九十0-9]+章|chapter[0-9]+|[0-9]+)", "")


def clean_term(c: Column) -> Column:
    """Without list markers, quotes, brackets and sentence marks, blanks collapsed."""
    out = F.regexp_replace(c, rf"^{WS}*[-0-9.)\]*]+{WS}*", "")
    out = F.regexp_replace(out, r"[\"'“”‘’\[\]{}()（），,、。.?？！!\n\r]", "")
    return trim_ws(F.regexp_replace(out, f"{WS}+", " "))


def term_key(c: Column) -> Column:
    """What makes two terms the same: lower case, without marks and blanks."""
    return F.regexp_replace(F.lower(c), rf"[，,、。.?？！!\"'“”‘’\[\]{{}}()（）\-\\/]|{WS}", "")


def concept_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"{WS}|[（）()\[\]【】：:]", "")


def title_key(c: Column) -> Column:
    """What makes two titles the same: no numbering, marks or blanks, lower case."""
    bare = F.regexp_replace(F.lower(clean_title(c)), r"^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[0-9]+(?:\.[0-9]+)*)", "")
    return F.regexp_replace(bare, rf"{WS}|[、，,。.：:；;\-—_()（）\[\]【】]", "")


def clean_title(c: Column) -> Column:
    """Without marks of the parser, Markdown and bold signs, leaders and a page number after them."""
    out = F.regexp_replace(strip_marks(c), r"^[#\s]+|\*\*", "")
    return trim_ws(F.regexp_replace(out, r"[.·…]{3,}\s*[0-9]*\s*$", ""))


def render(template: str, values: dict[str, Column]) -> Column:
    """`{{name}}` replaced by values; unknown names stay, a null value renders as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def with_offsets(c: Column, step: int = 1000) -> Column:
    """`[offset:n]` before every `step` characters."""
    at = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(step))
    return F.array_join(F.transform(at, lambda i: F.concat(F.lit("[offset:"), i.cast("string"), F.lit("]"), F.substring(c, i + 1, F.lit(step)))), "")


def snippet(c: Column, n: int = 200, more: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def highlight(c: Column, query: str) -> Column:
    """HTML-escaped text with every case-insensitive occurrence of the query in <mark>; a blank query marks nothing."""
    import re

    safe = escape_html(c, quotes=True)
    if not query.strip():
        return safe
    escaped = query.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    return F.regexp_replace(safe, "(?i)(" + re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", escaped) + ")", "<mark>$1</mark>")


def human_size(n: Column) -> Column:
    kb, mb = n / 1024, n / 1048576
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def pages(c: Column) -> Column:
    """array<struct<page, text>> at the parser's page marks; text before the first mark is page 0 unless blank.
    Without marks, pages of 2000 characters from 1."""
    parts, numbers = F.split(c, PAGE_MARK, -1), F.regexp_extract_all(c, F.lit(PAGE_MARK), 1)
    marked = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(numbers, i - 1).cast("int")).alias("page"), trim_ws(p).alias("text")))
    marked = F.filter(marked, lambda s: (s["page"] > 0) | (s["text"] != ""))
    at = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(2000))
    plain = F.transform(at, lambda i, n: F.struct((n + 1).cast("int").alias("page"), F.substring(c, i + 1, F.lit(2000)).alias("text")))
    return F.when(F.size(numbers) > 0, marked).otherwise(plain)


def page_marks(c: Column) -> Column:
    """array<struct<pos, page>> of the parser's page marks, pos where the number's sign ends; a text is read once."""
    marks = lambda t: [(m.end(), int(m[1])) for m in re.finditer(r"--- 第(\d{1,9})页", t)]
    return F.pandas_udf(lambda s: s.map(marks, na_action="ignore"), "array<struct<pos:bigint,page:int>>")(c)


def page_asof(points: DataFrame, marks: DataFrame) -> DataFrame:
    """heading_id, page of points (heading_id, doc_id, start_pos): the page of the last mark (doc_id, pos, page) that ends
    at or before the point, 0 before any. Points of documents without a row in marks have none."""
    both = marks.where("pos is not null").select("doc_id", "pos", "page", F.lit(None).cast("string").alias("heading_id"))
    mine = points.join(marks.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("start_pos").alias("pos"), F.lit(None).cast("int").alias("page"), "heading_id")
    w = Window.partitionBy("doc_id").orderBy("pos", F.col("heading_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(mine).withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(w), F.lit(0)))
    return seen.where("heading_id is not null").select("heading_id", "page")


def page_at(c: Column, offset: Column) -> Column:
    """Page of the last mark that begins before the offset; 0 before any."""
    before = F.regexp_extract_all(F.substring(c, F.lit(1), offset.cast("int")), F.lit(r"--- 第(\d+)页"), 1)
    return F.coalesce(F.try_element_at(before, F.lit(-1)).cast("int"), F.lit(0))


# -- predicates over terms ---------------------------------------------------------------------------
# Signs and forms that terms do not have, by what they show.
MATH_SIGNS = r"[∑∫∂∇√∞≈≠≤≥±×÷∈∉⊂⊆∪∩∀∃αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ]"
VARIABLE = r"^[a-zA-Z][0-9]?$|^[a-zA-Z]_[a-zA-Z0-9]+$|^d[xyzt]$"
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*[.、\s]"
FRAGMENT_START = r"^[)）\]】,，.。、;；:：的了着过们]"
PARTICLE_END = "[的是为与]$"
OPERATORS = "[+=<>^~]"
#: Never part of a term or an entity.
COMMON_FAULTS = {"mathematics": MATH_SIGNS, "variable": VARIABLE, "numbering": NUMBERED, "torn": FRAGMENT_START, "operator": OPERATORS, "short latin": "^[a-z]{1,3}$"}
#: Beyond those, of terms and of entities.
TERM_FAULTS = {"number": "^[0-9]+$", "abbreviation": "^[A-Z]{2,3}$", "particle": "^[的是在中为和以与或得次量互维]", "preposition": "^(?:关于|对于|通过|由于|基于|根据|按照|随着|除了|至于|作为|为了)", "particle at the end": PARTICLE_END}
ENTITY_FAULTS = {"joined": "[，,、]", "arrow or slash": r"[→←↔⇒⇐⇔/\\]", "lone letter": r"^[a-zA-Z]\s+"}
#: Greatest length, and number of ideographs, of terms and of strong ones; lengths of entities.
TERM_MOST, STRONG_MOST, ENTITY_LENGTHS = (16, 10), (20, 15), (2, 18)


def faults(c: Column, *tables: dict[str, str]) -> Column:
    """Whether a text shows any of the named faults."""
    found = [c.rlike(p) for table in tables for p in table.values()]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def is_valid_term(c: Column, stop_words: list[str], strong: bool = False) -> Column:
    """Could be a term: of fair length, no stop word, number, variable, formula, fragment or lone abbreviation. Null: false."""
    longest, ideographs = STRONG_MOST if strong else TERM_MOST
    size = F.length(c).between(2, longest) & (F.regexp_count(c, F.lit(CJK)) <= ideographs)
    says = c.rlike("[a-zA-Z0-9一-龥]") & (~c.rlike("[a-zA-Z]") | c.rlike("[a-zA-Z]{2}"))
    assumed = c.rlike("^设") & (F.length(c) <= 4)
    return F.coalesce(size & says & ~assumed & ~c.isin(stop_words) & ~faults(c, COMMON_FAULTS, TERM_FAULTS), F.lit(False))


def is_garbage_entity(c: Column, stop_words: list[str]) -> Column:
    """Structural rubbish: wrong length, stop word, formula, fragment, joined words, arrows, numbering. Null: true."""
    signs, letters = F.regexp_count(c, F.lit(r"[+\-*/=<>^~|]")), F.regexp_count(c, F.lit("[一-龥a-zA-Z0-9]"))
    dense = (letters > 0) & (signs / (signs + letters) > 0.25)
    roman_count = c.rlike("[IVXivx]") & c.rlike("[0-9]")
    short_particle = c.rlike(PARTICLE_END) & (F.length(c) <= 5)
    return F.coalesce(~F.length(c).between(*ENTITY_LENGTHS) | c.isin(stop_words) | faults(c, COMMON_FAULTS, ENTITY_FAULTS) | dense | roman_count | short_particle, F.lit(True))


def is_quality_word(c: Column, pmi: Column, n: Column, stop_words: list[str], functional: list[str], endings: list[str]) -> Column:
    """No rubbish and no functional ending, with a PMI above what its count asks for (-2 above 5, -1 above 2, else 1); the ending
    of a discipline is always good enough. Null: false."""
    ends = lambda xs: c.rlike("(?:" + "|".join(xs) + ")$") if xs else F.lit(False)
    asked = F.when(n > 5, -2.0).when(n > 2, -1.0).otherwise(1.0)
    return F.coalesce(~is_garbage_entity(c, stop_words) & (ends(endings) | (~ends(functional) & (pmi > asked))), F.lit(False))


# -- predicates over lines ---------------------------------------------------------------------------
def is_page_number_line(c: Column) -> Column:
    t = trim_ws(c)
    return t.rlike(r"^第\s*[0-9一二三四五六七八九十百千万]+\s*页$|^[-—–\s]*[0-9]+[-—–\s]*$|^(?i:page)\s+[0-9]+$|^[0-9]+\s*/\s*[0-9]+$") | t.rlike(r"第\s*[0-9]+\s*页\s*[/／]?\s*共\s*[0-9]+\s*页")


def is_formula_line(c: Column) -> Column:
    t = trim_ws(c)
    ops, letters = F.regexp_count(t, F.lit(r"[+\-*/=<>^~|]")), F.regexp_count(t, F.lit(r"[一-龥a-zA-Z0-9]"))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    variables = F.size(F.filter(words, lambda w: w.rlike(r"^[a-zA-Z]{1,2}[0-9]*$")))
    many = (F.size(words) >= 2) & (variables / F.size(words) >= 0.7)
    return (t != "") & (t.rlike(MATH_SIGNS) | ((letters > 0) & (ops / (ops + letters) > 0.35)) | many | t.rlike(r"\([^)]*[+\-*/=^][^)]*\)") | t.rlike(r"^[0-9\s+\-*/=^().]+$"))


# Forms of rows of a table of contents, by what ends them.
TOC_FORMS = {
    "spaced dots": r"\.\s*\.\s*\.\s*[0-9]+$",
    "leader": r"[·…]{2,}\s*[0-9]+$",
    "open leader": r"^.{2,30}[·．.]{3,}$",
    "number and page": r"^(?:第\s*[一二三四五六七八九十百千万0-9]+\s*[章节]?|[0-9]+(?:\.[0-9]+)*)\s*[、．.\s]*\S*[一-龥a-zA-Z].*?\s+[0-9]{1,4}$",
    "title and page": r"^[一-龥a-zA-Z].+?\s*[.·\-]{2,}\s*[0-9]{1,4}$",
}


def is_toc_line(c: Column) -> Column:
    """A row of a table of contents; bookmark marks are none."""
    t = trim_ws(c)
    return faults(t, TOC_FORMS) & ~t.rlike(r"^\[bookmark:L[0-9]+\]")


# Forms of heading lines, the first that fits counts.
HEADING_FORMS = [
    ("bookmark", r"^\[bookmark:L([0-9]+)\]\s*(.+)$"),
    ("markdown", r"^(#{1,6})\s+(.+)$"),
    ("chapter", r"^第\s*([一二三四五六七八九十百千万0-9]+)\s*章\s*[：:.\s]*(.+)$"),
    ("sectionZh", r"^第\s*([一二三四五六七八九十百千万0-9]+)\s*节\s*[：:.\s]*(.+)$"),
    ("section", r"^([0-9]+(?:\.[0-9]+)+)\s*[、．.\s]+(.+)$"),
    ("numericChapter", r"^([0-9]{1,2})\s*[.．、\s]\s*(.{2,80})$"),
    ("chineseSection", r"^([一二三四五六七八九十]+)[、．.\s]+(.{2,40})$"),
    ("bold", r"^(\*\*)\s*(.+?)\s*\*\*$"),
    ("bracketNumber", r"^[(（]([一二三四五六七八九十百千万0-9]+)[)）]\s*[.．:：\s]*(.{2,80})$"),
    ("alphaRoman", r"^([A-Z]|[IVXivx]{1,5})[.．\s]\s*(.{2,80})$"),
]


def heading_form(c: Column) -> Column:
    """struct<kind, mark, title> of the first heading form a trimmed line fits; null if none."""
    t = trim_ws(c)
    return F.coalesce(*[F.when(t.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(t, p, 1).alias("mark"), trim_ws(F.regexp_extract(t, p, 2)).alias("title"))) for k, p in HEADING_FORMS])


def heading_level(form: Column) -> Column:
    """Level by form: Markdown signs, depth of numbers (at most 4), 1 for chapters, 2 for sections and Roman numerals, 3 else."""
    kind, mark = form["kind"], form["mark"]
    depth = F.least(F.size(F.split(mark, r"\.")), F.lit(4))
    return (
        F.when(kind == "markdown", F.length(mark))
        .when(kind == "bookmark", F.least(mark.cast("int") + 1, F.lit(6)))
        .when(kind.isin("chapter", "numericChapter"), 1)
        .when(kind == "sectionZh", 2)
        .when(kind == "section", depth)
        .when(kind == "bracketNumber", 4)
        .when((kind == "alphaRoman") & mark.rlike("^[IVXivx]+$"), 2)
        .when(kind.isNotNull(), 3)
    )
