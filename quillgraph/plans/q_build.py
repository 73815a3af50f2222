"""Queries over graph building, ideas, matching layers and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import chunking as ck
from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.operators import build as b
from quillgraph.operators import graph as g
from quillgraph.operators import hierarchy as hi
from quillgraph.operators import ideas as im
from quillgraph.operators import terms as tm
from quillgraph.plans import q_graph as qg
from quillgraph.plans import q_match as qm
from quillgraph.plans import q_terms as qt
from quillgraph.plans import q_text as qx
from quillgraph.plans.q_graph import _A, _E, _HV, _adj, _edges, _ppr_sql
from quillgraph.plans.q_match import _LF, _NV, _nodes, _tsim
from quillgraph.plans.q_terms import _DICT, _dict_tokens, _docs, _terms
from quillgraph.plans.q_text import _has, _heads, _rep, _trim
from quillgraph.plans.shared import latest, table


def _full(spark, d):
    """Counted nodes with heading_id."""
    cols = ("doc_id", "heading_id", "node_type", "content", "keyword", "weight", "aliases")
    return latest(table(spark, d, "graph_nodes").select("node_id", *cols, "ingested_at"), "node_id", "ingested_at", *cols)


def heading_graph(spark, d):
    return b.heading_graph(table(spark, d, "headings")).distinct()


def entity_scores(spark, d):
    """Entities and concepts of every document by their paragraphs; the score of a node is its weight."""
    p = _docs(spark, d).select("doc_id", F.explode(tk.paragraphs(F.col("text"))).alias("p"))
    e = _nodes(spark, d).where("node_type in ('entity', 'concept') and doc_id is not null and length(content) >= 2").groupBy("doc_id", "content").agg(F.max(F.coalesce("weight", F.lit(0.5))).alias("score"))
    return b.entity_scores(p, e).select("doc_id", "content", "df", "rank", F.round("total", 6).alias("total"))


def entity_headings(spark, d):
    e = _nodes(spark, d).where("node_type in ('entity', 'concept') and doc_id is not null and length(content) >= 2")
    return b.entity_headings(e, table(spark, d, "documents"), _heads(spark, d))


def section_links(spark, d):
    s = b.section_links(table(spark, d, "headings"), _full(spark, d), _edges(spark, d))
    return s.select("doc_id", "a", "b", "shared", "crossing", F.round("weight", 6).alias("weight"))


def node_display(spark, d):
    r = qg.pagerank(spark, d)
    return b.node_display(r).select("node_id", F.round("size", 4).alias("size"), "is_hub")


def graph_report(spark, d):
    return b.graph_report(_nodes(spark, d), g.upsert_edges(_edges(spark, d)))


def doc_keywords(spark, d):
    k = b.document_keywords(_nodes(spark, d))
    return k.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("keyword").alias("first"), F.max("keyword").alias("last"))


def doc_relevance(spark, d):
    """Documents whose id is divisible by 50 against all that share a keyword of their headings and entities."""
    src = table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id")
    r = b.document_relevance(_nodes(spark, d), src, _terms(spark, d))
    # halves of the last place are moved up before rounding, so that both engines round them alike
    return r.select("doc_a", "doc_b", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("jaccard", "name_sim", "relevance")])


def cross_links(spark, d):
    n, t = _nodes(spark, d), _terms(spark, d)
    src = table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id")
    c = b.best_cross_links(n, src, t)
    return c.select("order", "from_id", "to_id", F.round("sim", 6).alias("sim"), F.round("relevance", 6).alias("relevance"))


def new_links(spark, d):
    """Valid edges of the last 90 days of deliveries whose key was not there before."""
    e = _edges(spark, d)
    edge = e.agg(F.max("ingested_at")).first()[0]
    cut = F.lit(edge) - F.expr("interval 90 days")
    old, new = e.where(F.col("ingested_at") <= cut), g.upsert_edges(e.where(F.col("ingested_at") > cut))
    return b.new_links(old, new, _nodes(spark, d)).select("from_id", "to_id", "edge_type")


def merged_concepts(spark, d):
    return b.merge_concepts(_nodes(spark, d), _edges(spark, d), _terms(spark, d))[2]


def graph_score(spark, d):
    a = _adj(spark, d)
    seed = a.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    r = g.personalized_pagerank(a, _nodes(spark, d), seed, iterations=10, stop=0.0)
    return b.graph_score(a, r, seed).select("node_id", "common", F.round("score", 6).alias("score"))


def neighbourhood(spark, d):
    ideas = _nodes(spark, d).where("node_type = 'idea'")
    return b.neighbourhood(_edges(spark, d).where("from_id is not null and to_id is not null"), ideas)


def node_groups(spark, d):
    return b.node_groups(_nodes(spark, d), "energy")


def structural_graph(spark, d):
    return b.structural_graph(table(spark, d, "headings"), table(spark, d, "documents"))


def visible_tree(spark, d):
    """Edges between visible nodes when every document and heading is opened."""
    n = _nodes(spark, d)
    tree = hi.hierarchy(hi.node_links(table(spark, d, "graph_nodes"), _edges(spark, d)), with_paths=True)
    return b.visible_tree(tree, n.where("node_type in ('document', 'heading')").select("node_id"), g.upsert_edges(_edges(spark, d)))[0]


def _ideas(spark, d):
    n = _nodes(spark, d).where("node_type = 'idea'")
    return n.select(F.col("node_id").alias("idea_id"), F.col("content").alias("title"), "doc_id")


def _idea_links(spark, d):
    e = _edges(spark, d).where("edge_type = 'idea-hierarchy' and from_id is not null and to_id is not null")
    return e.select(F.col("to_id").alias("child"), F.col("from_id").alias("parent")).distinct()


def idea_checks(spark, d):
    i = _ideas(spark, d)
    return i.select("idea_id", F.coalesce(im.idea_problem(F.col("title"), F.col("title")), F.lit("-")).alias("problem"), F.size(im.split_tags(F.col("title"))).alias("n_tags"))


def idea_cycles(spark, d):
    """For every link of an idea the move that turns it round."""
    l = _idea_links(spark, d)
    return im.makes_cycle(l, l.select(F.col("parent").alias("child"), F.col("child").alias("parent")).distinct())


def idea_subtrees(spark, d):
    """Nodes that go when all ideas of the documents with an id divisible by 3 are deleted, which is the caller's choice here."""
    return im.subtree(_idea_links(spark, d), _ideas(spark, d).where("doc_id % 3 = 0").select(F.col("idea_id").alias("node_id")))


def idea_edges(spark, d):
    i = _ideas(spark, d).withColumn("doc_node", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    none = i.limit(0).select("idea_id", F.col("idea_id").alias("node_id"))
    out = im.idea_edges(i, _idea_links(spark, d), _edges(spark, d).where("from_id is not null and to_id is not null and edge_type is not null"), none)
    return out.groupBy("edge_type").agg(F.count("*").alias("n"), F.min("from_id").alias("first_from"), F.max("to_id").alias("last_to"))


def project_names(spark, d):
    p = table(spark, d, "projects")
    return p.select("project_id", F.coalesce(im.project_name_problem(F.col("project_name")), F.lit("-")).alias("problem"))


def free_names(spark, d):
    """Names that copies of all documents would get."""
    docs = table(spark, d, "documents").where("doc_name is not null").select(F.col("doc_id").alias("id"), F.col("doc_name").alias("name"))
    return im.free_names(docs, docs.limit(0)).select("id", "free")


def matched_keywords(spark, d):
    """The ten best keywords of documents with an id divisible by 50 that other documents have among theirs."""
    k = tm.keywords(qt._counts(spark, d), "doc_id", _terms(spark, d), qx.STOP)
    q = k.where("doc_id % 50 = 0 and rank <= 10").select(F.col("doc_id").alias("query_id"), F.col("rank").alias("r"), "word")
    j = q.join(k.select("doc_id", "word"), "word").where("doc_id <> query_id")
    return j.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), "|").alias("words"))


def embedding_cache(spark, d):
    """Texts embedded once per distinct text: digest, and how many documents share it."""
    return _docs(spark, d).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def cjk_grams(spark, d):
    t = _docs(spark, d).select("doc_id", F.explode(tk.cjk_terms(F.col("text"))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 20")


def chunk_cleanup(spark, d):
    docs = table(spark, d, "documents").where("raw_text is not null")
    out = docs.select("doc_id", ck.cleaned(F.col("raw_text")).alias("t"))
    return out.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


def overlap_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("raw_text", "text").alias("t")).where("t <> ''")
    return docs.select("doc_id", F.posexplode(ck.overlapping(F.col("t"), 1500, 180)).alias("ord", "chunk")).select("doc_id", "ord", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def heading_chunks(spark, d):
    docs = table(spark, d, "documents").where("raw_text <> ''").select("doc_id", "raw_text")
    return ck.by_headings(docs, _heads(spark, d), 1500, 180).select("doc_id", "ord", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def exam_papers(spark, d):
    return _docs(spark, d).where(ck.is_exam_paper(F.col("text"))).select("doc_id")


def textbook_sections(spark, d):
    return ck.textbook_sections(_docs(spark, d)).select("doc_id", "ord", "chapter", "title", F.length("content").alias("n"))


def exam_questions(spark, d):
    return ck.exam_questions(_docs(spark, d)).select("doc_id", "ord", "section", F.length("question").alias("n"))


def first_terms(spark, d):
    """First spelling of every keyword of a document, letter case aside, in node order."""
    n = _nodes(spark, d).where("doc_id is not null and keyword is not null").select("doc_id", "node_id", "keyword")
    return tm.first_terms(n, "doc_id", "keyword", "node_id").select("doc_id", "keyword")


def context_lines(spark, d):
    """The lines around every heading start, two on each side."""
    h = _heads(spark, d).where("start_pos is not null").select("heading_id", "doc_id", "start_pos")
    return ck.context_lines(table(spark, d, "documents").where("raw_text is not null").select("doc_id", "raw_text"), h, 2)


def content_fallback(spark, d):
    """Content of a document: its raw text, else its sections under their titles."""
    secs = _heads(spark, d).select("doc_id", "ord", F.col("heading_id"), "title", F.lit("").alias("content"))
    return ck.content_or_sections(table(spark, d, "documents").select("doc_id", "raw_text"), secs).select("doc_id", F.md5("content").alias("digest"))


def document_graph(spark, d):
    """Nodes and edges by kind of the graph built from all documents alone."""
    n, e = b.document_graph(table(spark, d, "documents"), table(spark, d, "headings"), _terms(spark, d), qx.STOP)
    kinds = lambda df, what, k: df.groupBy(F.lit(what).alias("what"), F.col(k).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))
    return kinds(n, "node", "node_type").unionByName(kinds(e, "edge", "edge_type"))


def question_sentences(spark, d):
    """The five sentences of its document nearest to every line that begins like a question."""
    from quillgraph.operators.matching import question_sentences as nearest

    docs = _docs(spark, d)
    q = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("question", "text")).where(F.col("text").rlike(qt._BEGIN) & (F.length("text") >= 15))
    s = docs.select("doc_id", F.posexplode(tk.sentences(F.col("text"))).alias("ord", "text"))
    return nearest(q, s, qx.STOP).select("doc_id", "question", "ord", "rank", F.round("sim", 6).alias("sim"))


def heading_outline(spark, d):
    """Headings found in the raw texts alone."""
    from quillgraph.operators.outline import outline

    return outline(table(spark, d, "documents").select("doc_id", "raw_text")).select("doc_id", "ord", "level", "title", "start_pos", "end_pos", "parent")


QUERIES = {f"q_{f.__name__}": f for f in (heading_graph, entity_scores, entity_headings, section_links, node_display, graph_report, doc_keywords, doc_relevance, cross_links, new_links, merged_concepts, graph_score, neighbourhood, node_groups, structural_graph, visible_tree, idea_checks, idea_cycles, idea_subtrees, idea_edges, project_names, free_names, matched_keywords, embedding_cache, cjk_grams, chunk_cleanup, overlap_chunks, heading_chunks, exam_papers, textbook_sections, exam_questions, first_terms, context_lines, content_fallback, question_sentences, document_graph, heading_outline)}

# -- SQL ---------------------------------------------------------------------------------------------
_TREE = qg.ORACLES["q_heading_tree"]
_FULL = "fv as (select *, row_number() over (partition by node_id order by ingested_at desc, doc_id desc nulls last, heading_id desc nulls last, node_type desc nulls last, content desc nulls last, keyword desc nulls last, weight desc nulls last, aliases desc nulls last) rn from graph_nodes where node_id is not null), fn as (select * from fv where rn = 1)"
_PAR = rf"""pp as (select doc_id, unnest(case when len(q) > 0 then q when {_trim('text')} <> '' then [{_trim('text')}] else [] end) p from (select doc_id, text, case when len(b) >= 3 then b else l end q from (select doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda s: {_trim('s')}), lambda s: length(s) > 30) b, list_filter(list_transform(string_split_regex(text, '\n+'), lambda s: {_trim('s')}), lambda s: length(s) > 30) l from documents where text <> '')))"""
_LINKFORM = _LF.format("content")
_LK = rf"""dk as (select distinct doc_id, unnest(list_concat(list_filter(string_split_regex(f, '[^一-龥a-z0-9]+'), lambda w: length(w) >= 2), flatten(list_transform(regexp_extract_all(f, '[一-龥]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, cast(i as int), 2)))))) keyword from (select doc_id, {_LINKFORM} f from nodes where node_type in ('heading', 'entity') and doc_id is not null and content is not null))"""
_ILINK = "il as (select distinct to_id child, from_id parent from graph_edges where edge_type = 'idea-hierarchy' and from_id is not null and to_id is not null)"
_CTX = "ln as (select doc_id, i, l[i + 1] line, (select coalesce(sum(length(x) + 1), 0) from (select unnest(l[:i]) x)) p from (select doc_id, l, unnest(range(len(l))) i from (select doc_id, string_split(raw_text, chr(10)) l from documents where raw_text is not null)))"

ORACLES = {
    "q_heading_graph": f"with t as ({_TREE}), {_HV} select distinct heading_id node_id, parent parent_id, 5 - coalesce(heading_level, 3) weight, 18 - 3 * coalesce(heading_level, 3) size, case when parent is not null then 3.0::double end edge_weight from h left join t on child = heading_id",
    "q_entity_scores": f"with {_NV}, {_PAR}, en as (select doc_id, content, max(coalesce(weight, 0.5)) score from nodes where node_type in ('entity', 'concept') and doc_id is not null and length(content) >= 2 group by 1, 2), df as (select doc_id, content, count(*) df from en join pp using (doc_id) where contains(p, content) group by 1, 2), s as (select doc_id, content, df, score * (1 + ln(df + 1.0)) total from en join df using (doc_id, content)), r as (select *, row_number() over (partition by doc_id order by round(total, 9) desc, content) rank from s where total > 0) select doc_id, content, df, rank, round(total, 6) total from r where rank <= 80",
    "q_section_links": f"with recursive t as ({_TREE}), up as (select child item, parent anc, 1 d from t union all select up.item, t.parent, up.d + 1 from up join t on up.anc = t.child where up.d < 40), bad as (select distinct item from up where d >= 40), top as (select item, arg_max(anc, d) top from up where anc not in (select child from t) and item not in (select item from bad) group by 1), {_HV}, ht as (select heading_id, doc_id, coalesce(top, heading_id) top from h left join top on item = heading_id where doc_id is not null), {_FULL}, inn as (select node_id, ht.doc_id, top, content from fn join ht using (heading_id) where node_type in ('entity', 'concept') and content is not null), c as (select distinct doc_id, top, content from inn), sh as (select x.doc_id, x.top a, y.top b, count(*) shared from c x join c y on x.doc_id = y.doc_id and x.content = y.content and x.top < y.top group by 1, 2, 3), cr as (select f.doc_id, least(f.top, t2.top) a, greatest(f.top, t2.top) b, count(*) crossing from graph_edges e join inn f on e.from_id = f.node_id join inn t2 on e.to_id = t2.node_id where e.edge_type not in ('contains', 'hierarchy', 'includes', 'belong', 'idea-hierarchy') and f.doc_id = t2.doc_id and f.top <> t2.top group by 1, 2, 3), o as (select doc_id, a, b, coalesce(shared, 0) shared, coalesce(crossing, 0) crossing from sh full join cr using (doc_id, a, b)) select doc_id, a, b, shared, crossing, round(least(1 + 0.5 * shared + 0.3 * crossing, 5), 6) weight from o",
    "q_node_display": f"with pr as ({qg.ORACLES['q_pagerank']}), m as (select max(rank) most from pr) select node_id, round(8 + 22 * case when most > 0 then rank / most else 0.0 end, 4) size, case when most > 0 then rank / most else 0.0 end > 0.5 is_hub from pr, m",
    "q_graph_report": f"with {_NV}, {_E}, a as (select count(*) n_nodes, count(distinct node_type) n_types from nodes), x as (select count(*) n_edges from e), i as (select count(*) isolated from nodes where node_id not in (select from_id from e union select to_id from e)) select n_nodes, n_edges, round(2 * n_edges / greatest(n_nodes, 1), 2) avg_degree, n_types, isolated from a, x, i",
    "q_doc_keywords": f"with {_NV}, {_LK} select doc_id, count(*) n, min(keyword) first, max(keyword) last from dk group by 1",
    "q_doc_relevance": f"with {_DICT}, {_NV}, {_LK}, sz as (select doc_id, count(*) n from dk group by 1), bo as (select least(x.doc_id, y.doc_id) a, greatest(x.doc_id, y.doc_id) b, count(distinct x.keyword) k from dk x join dk y using (keyword) where x.doc_id % 50 = 0 and x.doc_id <> y.doc_id group by 1, 2), nm as (select doc_id, min(content) nm from nodes where node_type = 'document' and doc_id is not null group by 1), tt as (select doc_id, list(distinct token) t from {_dict_tokens('nm', 'nm', 'doc_id')} group by 1), p as (select a doc_a, b doc_b, k / (x.n + y.n - k) jaccard, coalesce(p.nm, '') na, coalesce(q.nm, '') nb, coalesce(ta.t, []) ta, coalesce(tb.t, []) tb from bo join sz x on x.doc_id = a join sz y on y.doc_id = b left join nm p on p.doc_id = a left join nm q on q.doc_id = b left join tt ta on ta.doc_id = a left join tt tb on tb.doc_id = b), s as (select doc_a, doc_b, jaccard, {_tsim('na', 'nb', 'ta', 'tb')} name_sim from p) select doc_a, doc_b, round(jaccard + 1e-9, 6) jaccard, round(name_sim + 1e-9, 6) name_sim, round(case when name_sim >= 0.6 then greatest(0.8, name_sim) else least(1.0, 0.9 * jaccard + 0.3 * name_sim) end + 1e-9, 6) relevance from s",
    "q_new_links": f"with {_NV}, mx as (select max(ingested_at) m from graph_edges), kk as (select *, case when edge_type in ({qg._UND}) then least(from_id, to_id) || '|' || greatest(from_id, to_id) else from_id || '|' || to_id end || '|' || edge_type k from graph_edges where from_id is not null and to_id is not null and edge_type is not null), nw as (select k, arg_min(from_id, (ingested_at, from_id, to_id)) from_id, arg_min(to_id, (ingested_at, from_id, to_id)) to_id, any_value(edge_type) edge_type from kk, mx where ingested_at > m - interval 90 days group by 1) select from_id, to_id, edge_type from nw where k not in (select k from kk, mx where ingested_at <= m - interval 90 days) and edge_type in ({qg._TYPES}) and from_id in (select node_id from nodes) and to_id in (select node_id from nodes)",
    "q_graph_score": f"with pr as ({{PPR}}), {_A}, sd as (select src s from adj group by 1 order by count(*) desc, src limit 1), one as (select distinct dst x from adj where src = (select s from sd)), n1 as (select count(*) n1 from adj where src = (select s from sd)), n2 as (select src node_id, count(*) n2 from adj group by 1), cm as (select src node_id, count(*) common from adj where dst in (select x from one) group by 1), o as (select pr.node_id, rank, coalesce(n2, 0) n2, coalesce(common, 0) common, n1 from pr left join n2 using (node_id) left join cm using (node_id), n1) select node_id, common, round(case when node_id = (select s from sd) then 1.0 else 0.5 * case when n1 + n2 - common > 0 then common / (n1 + n2 - common) else 0.0 end + least(10 * rank, 0.5) end, 6) score from o",
    "q_neighbourhood": f"with {_NV} select distinct node_id, neighbour from (select from_id node_id, to_id neighbour from graph_edges union all select to_id, from_id from graph_edges) where node_id is not null and neighbour is not null and node_id in (select node_id from nodes where node_type = 'idea')",
    "q_node_groups": f"with {_NV} select cast(coalesce(list_position({b.TYPE_ORDER!r}, node_type) - 1, 6) as int) ord, node_type, count(*) n, min(content) first from nodes where contains(lower(content), 'energy') group by 1, 2",
    "q_structural_graph": f"with {_HV}, x as (select * from h where heading_level in (1, 2) and ord is not null and doc_id in (select doc_id from documents)), y as (select *, last_value(case when heading_level = 1 then heading_id end ignore nulls) over (partition by doc_id order by ord, heading_id rows between unbounded preceding and 1 preceding) above from x) select case when heading_level = 1 then 'doc_' || doc_id else coalesce(above, 'doc_' || doc_id) end from_id, heading_id to_id, 'contains' edge_type from y",
    "q_idea_checks": rf"with {_NV} select node_id idea_id, case when trim(coalesce(content, '')) = '' or length(content) > 200 then 'title' when length(content) > 100000 then 'content' else '-' end problem, cast(len(list_distinct(list_filter(list_transform(string_split_regex(coalesce(content, ''), '[,，]'), lambda t: trim(t)), lambda t: t <> ''))) as int) n_tags from nodes where node_type = 'idea'",
    "q_idea_cycles": f"with recursive {_ILINK}, up as (select child item, parent anc, 1 d from il union select up.item, il.parent, up.d + 1 from up join il on up.anc = il.child where up.d < 40), bad as (select distinct item from up where d >= 40) select distinct parent child, child parent, parent = child or (child not in (select item from bad) and exists (select 1 from up where up.item = il.child and up.anc = il.parent)) \"cycle\" from il",
    "q_idea_subtrees": f"with recursive {_NV}, {_ILINK}, r as (select node_id from nodes where node_type = 'idea' and doc_id % 3 = 0), dn as (select node_id from r union select il.child from dn join il on il.parent = dn.node_id) select node_id from dn",
    "q_idea_edges": f"with {_NV}, {_ILINK}, id as (select node_id, doc_id from nodes where node_type = 'idea'), k as (select from_id, to_id, edge_type from graph_edges where from_id is not null and to_id is not null and edge_type is not null and edge_type not in ('idea-hierarchy', 'idea-link') and not (edge_type = 'belong' and from_id in (select node_id from id)) union select parent, child, 'idea-hierarchy' from il where child in (select node_id from id) and parent in (select node_id from id) union select node_id, 'doc_' || doc_id, 'belong' from id where doc_id is not null) select edge_type, count(*) n, min(from_id) first_from, max(to_id) last_to from k group by 1",
    "q_project_names": r"""select project_id, case when trim(coalesce(project_name, '')) = '' then 'blank' when length(trim(project_name)) > 50 then 'long' when regexp_matches(trim(project_name), '[<>:"/\\|?*]') then 'sign' else '-' end problem from projects""",
    "q_free_names": "select doc_id id, case when k = 1 then doc_name else doc_name || ' (' || k || ')' end free from (select doc_id, doc_name, row_number() over (partition by doc_name order by doc_id) k from documents where doc_name is not null)",
    "q_matched_keywords": f"with kk as ({qt.ORACLES['q_keywords']}) select q.doc_id query_id, k.doc_id doc_id, string_agg(q.word, '|' order by q.rank) words from kk q join kk k on q.word = k.word and q.doc_id <> k.doc_id where q.doc_id % 50 = 0 and q.rank <= 10 group by 1, 2",
    "q_embedding_cache": "select sha256(text) digest, count(*) n, min(doc_id) first from documents where text <> '' group by 1",
    "q_cjk_grams": r"""with r as (select doc_id, unnest(regexp_extract_all(text, '[一-龥]{2,}')) r from documents where text <> ''), gg as (select doc_id, unnest(list_concat(flatten(list_transform([2, 3, 4, 5, 6], lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substring(r, cast(i as int), cast(n as int))))), case when length(r) > 6 then [r] else [] end)) gram from r) select gram, count(*) n, count(distinct doc_id) n_docs from gg group by 1 having count(*) >= 20""",
    "q_exam_papers": rf"select doc_id from documents where text <> '' and length(text) >= 200 and (({_has('substring(text, 1, 6000)', ck.EXAM_HEADER)} and len(list_filter(string_split(substring(text, 1, 6000), chr(10)), lambda l: {_has('l', ck.NUMBERED_LINE)})) >= 2) or (len(list_filter(string_split(substring(text, 1, 6000), chr(10)), lambda l: {_has('l', ck.NUMBERED_LINE)})) >= 3 and {_has('substring(text, 1, 6000)', ck.EXAM_WORDS)}))",
    "q_first_terms": f"with {_NV} select doc_id, arg_min(keyword, node_id) keyword from nodes where doc_id is not null and keyword is not null group by doc_id, lower(keyword)",
    "q_content_fallback": f"with {_HV}, s as (select doc_id, string_agg('## ' || coalesce(title, '') || chr(10), chr(10) order by ord, heading_id) c from h group by 1) select doc_id, md5(coalesce(nullif(raw_text, ''), c, '')) digest from documents left join s using (doc_id)",
}
ORACLES["q_question_sentences"] = rf"""with docs as (select doc_id, text from documents where text <> ''),
qs as (select doc_id, i question, l[i + 1] text from (select doc_id, l, unnest(range(len(l))) i from (select doc_id, string_split(text, chr(10)) l from docs)) where regexp_matches(l[i + 1], '{qt._BEGIN}') and length(l[i + 1]) >= 15),
st as (select doc_id, i ord, s[i + 1] text from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, {qt._SENT} s from docs))),
sg as (select doc_id, ord, word, count(*) tf from {qt._ngrams('st', 'doc_id, ord')} where length(word) >= 2 and word not in ({qx._STOP}) group by 1, 2, 3), qgr as (select doc_id, question, word, count(*) tf from {qt._ngrams('qs', 'doc_id, question')} where length(word) >= 2 and word not in ({qx._STOP}) group by 1, 2, 3),
n as (select doc_id, count(*) n from st group by 1), idf as (select doc_id, word, ln((n + 1.0) / (df + 1)) + 1 idf from (select doc_id, word, count(*) df from sg group by 1, 2) join n using (doc_id)),
sv as (select doc_id, ord, word, tf * idf w from sg join idf using (doc_id, word)), qv as (select doc_id, question, word, tf * coalesce(idf, ln((n + 1.0) / 1.5) + 1) w from qgr join n using (doc_id) left join idf using (doc_id, word)),
c as (select qv.doc_id, question, ord, sum(qv.w * sv.w) d from qv join sv using (doc_id, word) group by 1, 2, 3), nq as (select doc_id, question, sqrt(sum(w * w)) nq from qv group by 1, 2), ns as (select doc_id, ord, sqrt(sum(w * w)) ns from sv group by 1, 2),
f as (select doc_id, question, ord, d / (nq * ns) sim from c join nq using (doc_id, question) join ns using (doc_id, ord)), r as (select *, row_number() over (partition by doc_id, question order by round(sim, 9) desc, ord) rank from f where sim > 0.05) select doc_id, question, ord, rank, round(sim, 6) sim from r where rank <= 5"""
_ppr = _ppr_sql().rpartition(" select ")
ORACLES["q_graph_score"] = ORACLES["q_graph_score"].replace("with pr as ({PPR}), " + _A + ",", _ppr[0] + ", pr as (select node_id, rank from r10),")
