"""Queries over cleaning functions, pages and line predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.plans.shared import latest, table

#: A small stop list of our own; any list can be given to the functions.
STOP = ["的", "了", "和", "与", "是", "在", "可以", "这个", "我们", "the", "and", "for", "with", "that", "this", "from"]


def detect_type(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.detect_type(F.col("doc_name")).alias("detected"), tx.mime_type(F.col("doc_name")).alias("mime"))


def strip_marks(spark, d):
    t = tx.strip_marks(F.col("raw_text"))
    return table(spark, d, "documents").where("raw_text is not null").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def text_to_html(spark, d):
    h = tx.text_to_html(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(h).alias("n"), F.md5(h).alias("digest"))


def html_to_text(spark, d):
    t = tx.html_to_text(tx.text_to_html(F.col("text")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def _contents(spark, d):
    return table(spark, d, "graph_nodes").where("content is not null").select("content").distinct()


def _keywords(spark, d):
    return table(spark, d, "graph_nodes").where("keyword is not null").select("keyword").distinct()


def link_form(spark, d):
    return _contents(spark, d).select("content", tx.link_form(F.col("content")).alias("form"))


def term_forms(spark, d):
    k = F.col("keyword")
    return _keywords(spark, d).select("keyword", tx.clean_term(k).alias("cleaned"), tx.term_key(k).alias("term_key"), tx.concept_key(k).alias("concept_key"))


def title_forms(spark, d):
    t = F.col("title")
    return table(spark, d, "headings").where("title is not null").select("title").distinct().select("title", tx.clean_title(t).alias("cleaned"), tx.title_key(t).alias("title_key"))


def term_checks(spark, d):
    k = F.col("keyword")
    return _keywords(spark, d).select("keyword", tx.is_valid_term(k, STOP).alias("valid"), tx.is_valid_term(k, STOP, True).alias("valid_strong"), tx.is_garbage_entity(k, STOP).alias("garbage"))


def pages(spark, d):
    p = table(spark, d, "documents").where("raw_text is not null").select("doc_id", F.explode(tx.pages(F.col("raw_text"))).alias("p"))
    return p.select("doc_id", F.col("p.page").alias("page"), F.length("p.text").alias("n"), F.md5("p.text").alias("digest"))


def _heads(spark, d):
    return latest(table(spark, d, "headings").drop("children"), "heading_id", "ingested_at")


def page_asof(spark, d):
    """Page of every heading start: marks and headings of a document sorted together; texts never leave their tasks."""
    h = _heads(spark, d).where("start_pos is not null").select("heading_id", "doc_id", "start_pos")
    docs = table(spark, d, "documents").where("raw_text is not null").select("doc_id", F.explode_outer(tx.page_marks(F.col("raw_text"))).alias("m"))
    return tx.page_asof(h, docs.select("doc_id", "m.pos", "m.page"))


def scan_test(spark, d):
    """Pages with few characters each are likely images."""
    p = table(spark, d, "documents").where("raw_text is not null")
    mean = F.length(F.regexp_replace("raw_text", r"\s", "")) / F.greatest(F.coalesce("total_pages", F.lit(1)), F.lit(1))
    return p.select("doc_id", F.round(mean, 6).alias("chars_per_page"), (mean < 50).alias("image_like"))


def template(spark, d):
    body = tx.render("{{name}} ({{id}}): {{description}} {{unknown}}", {"name": F.col("project_name"), "id": F.col("project_id"), "description": F.col("description")})
    return table(spark, d, "projects").select("project_id", body.alias("body"))


def offset_marks(spark, d):
    t = tx.with_offsets(F.col("text"))
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def snippets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.human_size(F.col("n_chars")).alias("size"))


def highlight(spark, d):
    h = tx.highlight(F.col("text"), "Temperature")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_count(h, F.lit("<mark>")).alias("marks"), F.md5(h).alias("digest"))


def ghost_fold(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(tx.fold_ghosts(F.col("text"))).alias("n"))


def mojibake(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", (tx.fix_mojibake(F.col("text")) != F.col("text")).alias("repaired"))


def _lines(spark, d):
    """Lines of every raw text without the font mark they begin with."""
    l = table(spark, d, "documents").where("raw_text is not null").select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    return l.withColumn("line", tx.strip_font_mark(F.col("line")))


def line_kinds(spark, d):
    """Page numbers, formulas and rows of tables of contents among the lines of every raw text."""
    c = F.col("line")
    out = _lines(spark, d).select("doc_id", "line_no", tx.is_page_number_line(c).alias("page_number"), tx.is_formula_line(c).alias("formula"), tx.is_toc_line(c).alias("toc"))
    return out.where("page_number or formula or toc")


def heading_lines(spark, d):
    """Lines in a heading form with kind, mark, title and level."""
    form = tx.heading_form(F.col("line"))
    out = _lines(spark, d).where(F.length("line").between(4, 120)).withColumn("f", form).where("f is not null")
    return out.select("doc_id", "line_no", "f.kind", "f.mark", "f.title", tx.heading_level(F.col("f")).alias("level"))


QUERIES = {f"q_{f.__name__}": f for f in (detect_type, strip_marks, text_to_html, html_to_text, link_form, term_forms, title_forms, term_checks, pages, page_asof, scan_test, template, offset_marks, snippets, highlight, ghost_fold, mojibake, line_kinds, heading_lines)}

# -- SQL ---------------------------------------------------------------------------------------------
_WS = tx.WS
_STOP = ", ".join(f"'{w}'" for w in STOP)
_HTML = r"coalesce(array_to_string(list_transform(list_filter(string_split_regex(text, '\n\s*\n+'), lambda p: regexp_matches(p, '\S')), lambda p: '<p>' || replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p>'), ''), '')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _rep(x: str, p: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, '{p}')"


def _cnt(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


_K = "keyword"
_VALID = (
    f"length({_K}) between 2 and {{n}} and {_K} not in ({_STOP}) and not {_has(_K, '^[0-9]+$')} and {_has(_K, '[a-zA-Z0-9一-龥]')} and not {_has(_K, tx.MATH_SIGNS)} and not {_has(_K, tx.VARIABLE)}"
    f" and not {_has(_K, '^[A-Z]{2,3}$').replace('{', '{{').replace('}', '}}')} and not {_has(_K, tx.NUMBERED)} and not {_has(_K, tx.FRAGMENT_START)} and not {_has(_K, '^[的是在中为和以与或得次量互维]')} and not {_has(_K, '[+=<>^~]')} and not {_has(_K, '[的是为与]$')}"
    f" and not {_has(_K, '^(?:关于|对于|通过|由于|基于|根据|按照|随着|除了|至于|作为|为了)')} and not ({_has(_K, '^设')} and length({_K}) <= 4) and {_cnt(_K, tx.CJK)} <= {{c}}"
    f" and not ({_has(_K, '[a-zA-Z]')} and not {_has(_K, '[a-zA-Z]{2}').replace('{', '{{').replace('}', '}}')}) and not {_has(_K, '^[a-z]{1,3}$').replace('{', '{{').replace('}', '}}')}"
)
_OPS, _LET = _cnt(_K, r"[+\-*/=<>^~|]"), _cnt(_K, "[一-龥a-zA-Z0-9]")
_GARBAGE = (
    f"length({_K}) not between 2 and 18 or {_K} in ({_STOP}) or {_has(_K, tx.MATH_SIGNS)} or {_has(_K, tx.VARIABLE)} or {_has(_K, tx.NUMBERED)} or {_has(_K, tx.FRAGMENT_START)} or ({_has(_K, '[的是为与]$')} and length({_K}) <= 5)"
    f" or {_has(_K, '[+=<>^~]')} or {_has(_K, '[，,、]')} or ({_has(_K, '[IVXivx]')} and {_has(_K, '[0-9]')}) or {_has(_K, r'[→←↔⇒⇐⇔/\\]')} or {_has(_K, r'^[a-zA-Z]\s+')} or {_has(_K, '^[a-z]{1,3}$')} or ({_LET} > 0 and {_OPS} / ({_OPS} + {_LET}) > 0.25)"
)
_MARKS = r"\[fs\d+(?:\.\d+)?\]|\[bookmark:L\d+\]"
_CLEAN_TITLE = _trim(_rep(_rep(_rep("title", _MARKS), r"^[#\s]+|\*\*"), r"[.·…]{3,}\s*[0-9]*\s*$"))
_T = _trim("line")
_LOPS, _LLET = _cnt("t", r"[+\-*/=<>^~|]"), _cnt("t", "[一-龥a-zA-Z0-9]")
_LINES = r"l as (select doc_id, unnest(s) line, unnest(range(len(s))) line_no from (select doc_id, string_split(raw_text, chr(10)) s from documents where raw_text is not null)), x as (select doc_id, line_no, line, " + _T + " t from (select doc_id, line_no, " + _rep("line", rf"^{_WS}*\[fs\d+(?:\.\d+)?\]{_WS}*") + " line from l))"
_UNESC = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"

ORACLES = {
    "q_detect_type": r"""with e as (select doc_id, regexp_extract(lower(coalesce(doc_name, '')), '\.([a-z0-9]+)$', 1) x from documents)
select doc_id, case when x = 'pdf' then 'pdf' when x = 'docx' then 'docx' when x = 'pptx' then 'pptx' when x in ('doc', 'ppt') then 'unsupported' when x in ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp') then 'image' when x in ('md', 'markdown') then 'markdown' when x in ('js', 'py', 'ts') then 'code' else 'text' end detected,
 case when x in ('jpg', 'jpeg') then 'image/jpeg' when x in ('gif', 'bmp', 'webp') then 'image/' || x else 'image/png' end mime from e""",
    "q_strip_marks": f"select doc_id, length(t) n, md5(t) digest from (select doc_id, {_rep('raw_text', _MARKS)} t from documents where raw_text is not null)",
    "q_text_to_html": f"select doc_id, length(h) n, md5(h) digest from (select doc_id, {_HTML} h from documents where text is not null)",
    "q_html_to_text": "select doc_id, length(t) n, md5(t) digest from (select doc_id, " + _rep(_rep(_UNESC.format(_rep(_rep(_HTML, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n"), r"<[^>]+>")), r"\n{3,}", "\n\n"), r"^\s+|\s+$") + " t from documents where text is not null)",
    "q_link_form": "select content, " + _rep(_rep("lower(content)", rf"{_WS}|[\-_.，,、]"), r"^(?:第[一二三四五六七八九十0-9]+章|chapter[0-9]+|[0-9]+)") + " form from (select distinct content from graph_nodes where content is not null)",
    "q_term_forms": "select keyword, " + _trim(_rep(_rep(_rep("keyword", rf"^{_WS}*[-0-9.)\]*]+{_WS}*"), r"[\"'“”‘’\[\]{}()（），,、。.?？！!\n\r]"), f"{_WS}+", " ")) + " cleaned, " + _rep("lower(keyword)", rf"[，,、。.?？！!\"'“”‘’\[\]{{}}()（）\-\\/]|{_WS}") + " term_key, " + _rep("lower(keyword)", rf"{_WS}|[（）()\[\]【】：:]") + " concept_key from (select distinct keyword from graph_nodes where keyword is not null)",
    "q_title_forms": f"select title, {_CLEAN_TITLE} cleaned, " + _rep(_rep(f"lower({_CLEAN_TITLE})", r"^(?:第[一二三四五六七八九十百千万0-9]+[章节]|[0-9]+(?:\.[0-9]+)*)"), rf"{_WS}|[、，,。.：:；;\-—_()（）\[\]【】]") + " title_key from (select distinct title from headings where title is not null)",
    "q_term_checks": f"select keyword, {_VALID.format(n=16, c=10)} valid, {_VALID.format(n=20, c=15)} valid_strong, ({_GARBAGE}) garbage from (select distinct keyword from graph_nodes where keyword is not null)",
    "q_pages": rf"""with s as (select doc_id, raw_text, string_split_regex(raw_text, '{tx.PAGE_MARK.replace("(\\d+)", "[0-9]+")}') p, regexp_extract_all(raw_text, '{tx.PAGE_MARK}', 1) n from documents where raw_text is not null),
m as (select doc_id, case when i = 1 then 0 else cast(n[i - 1] as int) end page, {_trim('p[i]')} text from (select *, unnest(range(1, len(p) + 1)) i from s where len(n) > 0)),
q as (select doc_id, cast(i + 1 as int) page, substring(raw_text, cast(i * 2000 + 1 as int), 2000) text from (select *, unnest(range(greatest(1, cast(ceil(length(raw_text) / 2000.0) as int)))) i from s where len(n) = 0))
select doc_id, page, length(text) n, md5(text) digest from (select * from m where page > 0 or text <> '' union all select * from q)""",
    "q_page_asof": r"""with h as (select *, row_number() over (partition by heading_id order by ingested_at desc) rn from headings where heading_id is not null)
select heading_id, coalesce(cast(list_extract(regexp_extract_all(substring(raw_text, 1, cast(start_pos as int)), '--- 第(\d+)页', 1), -1) as int), 0) page from h join documents using (doc_id) where rn = 1 and start_pos is not null and raw_text is not null""",
    "q_scan_test": r"select doc_id, round(m, 6) chars_per_page, m < 50 image_like from (select doc_id, length(regexp_replace(raw_text, '\s', '', 'g')) / greatest(coalesce(total_pages, 1), 1) m from documents where raw_text is not null)",
    "q_template": "select project_id, coalesce(project_name, '') || ' (' || project_id || '): ' || coalesce(description, '') || ' {{unknown}}' body from projects",
    "q_offset_marks": "select doc_id, length(t) n, md5(t) digest from (select doc_id, array_to_string(list_transform(range(0, length(text), 1000), lambda i: '[offset:' || i || ']' || substring(text, cast(i + 1 as int), 1000)), '') t from documents where text <> '')",
    "q_snippets": "select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end snippet, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', n_chars / 1024) else printf('%.1f MB', n_chars / 1048576) end size from documents where text is not null",
    "q_highlight": "select doc_id, (length(h) - length(replace(h, '<mark>', ''))) // 6 marks, md5(h) digest from (select doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;'), '(?i)(Temperature)', '<mark>\\1</mark>', 'g') h from documents where text is not null)",
    "q_line_kinds": rf"""with {_LINES}, f as (select doc_id, line_no, t, list_filter(string_split_regex(t, '\s+'), lambda w: w <> '') ws from x),
k as (select doc_id, line_no,
 regexp_matches(t, '^第\s*[0-9一二三四五六七八九十百千万]+\s*页$|^[-—–\s]*[0-9]+[-—–\s]*$|^(?i:page)\s+[0-9]+$|^[0-9]+\s*/\s*[0-9]+$') or regexp_matches(t, '第\s*[0-9]+\s*页\s*[/／]?\s*共\s*[0-9]+\s*页') page_number,
 t <> '' and (regexp_matches(t, '{tx.MATH_SIGNS}') or ({_LLET} > 0 and {_LOPS} / ({_LOPS} + {_LLET}) > 0.35) or (len(ws) >= 2 and len(list_filter(ws, lambda w: regexp_matches(w, '^[a-zA-Z]{{1,2}}[0-9]*$'))) / len(ws) >= 0.7) or regexp_matches(t, '\([^)]*[+\-*/=^][^)]*\)') or regexp_matches(t, '^[0-9\s+\-*/=^().]+$')) formula,
 not regexp_matches(t, '^\[bookmark:L[0-9]+\]') and (regexp_matches(t, '\.\s*\.\s*\.\s*[0-9]+$|[·…]{{2,}}\s*[0-9]+$') or regexp_matches(t, '^.{{2,30}}[·．.]{{3,}}$') or regexp_matches(t, '^(?:第\s*[一二三四五六七八九十百千万0-9]+\s*[章节]?|[0-9]+(?:\.[0-9]+)*)\s*[、．.\s]*\S*[一-龥a-zA-Z].*?\s+[0-9]{{1,4}}$') or regexp_matches(t, '^[一-龥a-zA-Z].+?\s*[.·\-]{{2,}}\s*[0-9]{{1,4}}$')) toc from f)
select * from k where page_number or formula or toc""",
    "q_heading_lines": "with " + _LINES + ", k as (select *, case " + " ".join(f"when regexp_matches(t, '{p}') then '{k}'" for k, p in tx.HEADING_FORMS) + " end kind from x where length(line) between 4 and 120), m as (select doc_id, line_no, kind, case kind " + " ".join(f"when '{k}' then regexp_extract(t, '{p}', 1)" for k, p in tx.HEADING_FORMS) + " end mark, case kind " + " ".join(f"when '{k}' then {_trim(f'regexp_extract(t, {chr(39)}{p}{chr(39)}, 2)')}" for k, p in tx.HEADING_FORMS) + r""" end title from k where kind is not null)
select *, case when kind = 'markdown' then length(mark) when kind = 'bookmark' then least(cast(mark as int) + 1, 6) when kind in ('chapter', 'numericChapter') then 1 when kind = 'sectionZh' then 2 when kind = 'section' then least(len(string_split(mark, '.')), 4) when kind = 'bracketNumber' then 4 when kind = 'alphaRoman' and regexp_matches(mark, '^[IVXivx]+$') then 2 else 3 end as level from m""",
}
