"""Queries over similarity, matching and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import similarity as sim
from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.operators import matching as mt
from quillgraph.operators.nearest import nearest
from quillgraph.plans.q_terms import _DICT, _dict_tokens, _docs, _terms
from quillgraph.plans.shared import latest, table


def _nodes(spark, d):
    return latest(table(spark, d, "graph_nodes").select("node_id", "doc_id", "node_type", "content", "keyword", "weight", "aliases", "ingested_at"), "node_id", "ingested_at", "doc_id", "node_type", "content", "keyword", "weight", "aliases")


def _pairs(spark, d):
    """Distinct content and keyword of one node."""
    return table(spark, d, "graph_nodes").where("content is not null and keyword is not null").select("content", "keyword").distinct()


def text_similarity(spark, d):
    t = _terms(spark, d)
    return _pairs(spark, d).select("content", "keyword", F.round(sim.text_similarity(F.col("content"), F.col("keyword"), t), 6).alias("score"))


def term_similarity(spark, d):
    return _pairs(spark, d).select("content", "keyword", F.round(sim.term_similarity(F.col("content"), F.col("keyword")), 6).alias("score"))


def label_similarity(spark, d):
    t = _terms(spark, d)
    p = _pairs(spark, d).select("content", "keyword", tx.link_form(F.col("content")).alias("a"), tx.link_form(F.col("keyword")).alias("b"))
    return p.select("content", "keyword", F.round(sim.label_similarity(F.col("a"), F.col("b"), t), 6).alias("score"))


def _queries(spark, d):
    return _docs(spark, d).where("doc_id % 50 = 0")


def tfidf_topk(spark, d):
    """For every document whose id is divisible by 50 the ten nearest of all by TF-IDF cosine."""
    n = nearest(_docs(spark, d), _queries(spark, d), "doc_id", "text", _terms(spark, d), {"tfidf": 1.0})
    return n.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def jaccard_topk(spark, d):
    n = nearest(_docs(spark, d), _queries(spark, d), "doc_id", "text", _terms(spark, d), {"keyword": 1.0})
    return n.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def hybrid_match(spark, d):
    h = mt.hybrid(_docs(spark, d), _queries(spark, d), "doc_id", "text", _terms(spark, d))
    return h.select("query_id", "doc_id", "rank", *[F.round(c, 6).alias(c) for c in ("keyword", "tfidf", "semantic", "score")])


def stub_embedding(spark, d):
    e = _docs(spark, d).select("doc_id", F.posexplode(sim.stub_embedding(F.col("text"))).alias("dim", "value"))
    return e.select("doc_id", "dim", F.round("value", 6).alias("value"))


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return mt.vector_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_upsert(spark, d):
    e = table(spark, d, "embeddings")
    new = e.where("label = 3").select("vec_id", F.reverse("embedding").alias("embedding"), F.lit(99).alias("label"), F.col("vec_id").alias("ord"))
    u = mt.upsert_vectors(e.select("vec_id", "embedding", "label"), new)
    return u.select("vec_id", "label", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"))


def embedding_check(spark, d):
    n = F.size("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.min(n).alias("min_dim"), F.max(n).alias("max_dim"), F.count("*").alias("n"))


def search(spark, d):
    return mt.full_text(table(spark, d, "documents"), "equilibrium")


def node_search(spark, d):
    return mt.node_search(_nodes(spark, d), "energy").select("node_id", "content", "score")


def _ideas(spark, d):
    return _nodes(spark, d).where("node_type = 'idea' and content is not null").select(F.col("node_id").alias("idea_id"), "content")


def _targets(spark, d):
    return _nodes(spark, d).where("node_type in ('entity', 'concept') and content is not null").select("node_id", "content")


def inverted_candidates(spark, d):
    return mt.index_candidates(_ideas(spark, d), _targets(spark, d), "idea_id", "node_id", "content", _terms(spark, d))


def auto_link(spark, d):
    a = mt.auto_links(_ideas(spark, d), _targets(spark, d), "idea_id", "node_id", "content", _terms(spark, d))
    return a.select("idea_id", "node_id", F.round("score", 6).alias("score"), "rank")


def keyword_overlap(spark, d):
    """Weighted overlap of the token counts of content and keyword of every pair: sum of minima over the content's counts."""
    t = _terms(spark, d)
    p = _pairs(spark, d)
    a = p.select("content", "keyword", F.explode(tk.dict_tokens(F.col("content"), t)).alias("w")).groupBy("content", "keyword", "w").agg(F.count("*").alias("c1"))
    b = p.select("content", "keyword", F.explode(tk.dict_tokens(F.col("keyword"), t)).alias("w")).groupBy("content", "keyword", "w").agg(F.count("*").alias("c2"))
    j = a.join(b, ["content", "keyword", "w"], "left").groupBy("content", "keyword")
    return j.agg(F.round(F.sum(F.when(F.col("c2").isNotNull(), F.least("c1", "c2")).otherwise(0)) / F.sum("c1"), 6).alias("overlap"))


QUERIES = {f"q_{f.__name__}": f for f in (text_similarity, term_similarity, label_similarity, tfidf_topk, jaccard_topk, hybrid_match, stub_embedding, vector_topk, vector_upsert, embedding_check, search, node_search, inverted_candidates, auto_link, keyword_overlap)}

# -- SQL ---------------------------------------------------------------------------------------------
_WS = tx.WS
_NV = "nv as (select *, row_number() over (partition by node_id order by ingested_at desc, doc_id desc nulls last, node_type desc nulls last, content desc nulls last, keyword desc nulls last, weight desc nulls last, aliases desc nulls last) rn from graph_nodes where node_id is not null), nodes as (select * exclude (rn) from nv where rn = 1)"
_PAIR = "pairs as (select row_number() over () id, content, keyword from (select distinct content, keyword from graph_nodes where content is not null and keyword is not null))"


def _chars(x: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace({x}, '{_WS}', '', 'g'), '(?s).'))"


def _jac(a: str, b: str) -> str:
    return f"case when len(list_distinct(list_concat({a}, {b}))) > 0 then len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) else 0.0 end"


def _tsim(a: str, b: str, ta: str, tb: str) -> str:
    dice = f"case when len({ta}) + len({tb}) > 0 then 2 * len(list_intersect({ta}, {tb})) / (len({ta}) + len({tb})) else 0.0 end"
    loose = f"case when len({ta}) = 0 or len({tb}) = 0 then 0.0 else greatest({_jac(ta, tb)}, {dice}, {_jac(_chars(a), _chars(b))}) end"
    holds = f"length({a}) >= 2 and length({b}) >= 2 and (contains({a}, {b}) or contains({b}, {a}))"
    return f"case when length({a}) = 0 or length({b}) = 0 then 0.0 when {a} = {b} then 1.0 when {holds} then 0.5 + 0.5 * least(length({a}), length({b})) / greatest(length({a}), length({b})) else {loose} end"


_TOKA = f"ta as (select id, list(distinct token) t from {_dict_tokens('pairs', 'content', 'id')} group by 1), tb as (select id, list(distinct token) t from {_dict_tokens('pairs', 'keyword', 'id')} group by 1), pt as (select p.*, coalesce(ta.t, []) ta, coalesce(tb.t, []) tb from pairs p left join ta using (id) left join tb using (id))"
_KEY = rf"regexp_replace(lower({{}}), '[，,、。.?？！!\"''“”‘’\[\]{{{{}}}}()（）\-\\/]|{_WS.replace('{', '{{').replace('}', '}}')}', '', 'g')"
_LF = r"regexp_replace(regexp_replace(lower({}), '" + _WS.replace("{", "{{").replace("}", "}}") + r"|[\-_.，,、]', '', 'g'), '^(?:第[一二三四五六七八九十0-9]+章|chapter[0-9]+|[0-9]+)', '', 'g')"
_POST = f"with {_DICT}, docs as (select doc_id, text from documents where text <> ''), tok as {_dict_tokens('docs', 'text', 'doc_id')}, c as (select doc_id, token, count(*) c from tok group by 1, 2), post as (select *, sum(c) over (partition by doc_id) n, count(*) over (partition by doc_id) nd from c), df as (select token, count(*) df from c group by 1), v as (select doc_id, token, c / n * (ln(((select count(*) from docs) + 1.0) / (df + 1)) + 1) w from post join df using (token)), nrm as (select doc_id, sqrt(sum(w * w)) nr from v group by 1)"
_TF = "tfs as (select a.doc_id q, b.doc_id d, sum(a.w * b.w) s from v a join v b using (token) where a.doc_id % 50 = 0 group by 1, 2), tf as (select q, d, s / (x.nr * y.nr) score from tfs join nrm x on q = x.doc_id join nrm y on d = y.doc_id)"
_KWJ = "kwj as (select q, d, k / (na + nb - k) score from (select a.doc_id q, b.doc_id d, a.nd na, b.nd nb, count(*) k from post a join post b using (token) where a.doc_id % 50 = 0 group by 1, 2, 3, 4))"
_EMB = "ch as (select doc_id, unnest(cs) ch, unnest(range(len(cs))) i from (select doc_id, regexp_extract_all(text, '(?s).') cs from documents where text <> '')), raw as (select doc_id, i % 64 dim, sum(unicode(ch) / 65536.0::double) x from ch group by 1, 2), enr as (select doc_id, sqrt(sum(x * x)) nr from raw group by 1), ids as (select doc_id, unnest(range(64)) dim from documents where text <> ''), emb as (select ids.doc_id, ids.dim, coalesce(x / nr, 0) value from ids join enr using (doc_id) left join raw on raw.doc_id = ids.doc_id and raw.dim = ids.dim)"
_TOP = "select q query_id, d doc_id, rank, round(score, 6) score from (select *, row_number() over (partition by q order by round(score, 9) desc, d) rank from {}) where rank <= 10"
_IDX = f"with {_DICT}, {_NV}, qs as (select node_id, content from nodes where node_type = 'idea' and content is not null), it as (select node_id, content from nodes where node_type in ('entity', 'concept') and content is not null), kq as (select distinct node_id, token k from {_dict_tokens('qs', 'content', 'node_id')} union select node_id, unnest(regexp_extract_all(content, '[一-龥]')) from qs), ki as (select distinct node_id, token k from {_dict_tokens('it', 'content', 'node_id')} union select node_id, unnest(regexp_extract_all(content, '[一-龥]')) from it), sh as (select a.node_id idea_id, b.node_id, count(*) shared from kq a join ki b using (k) group by 1, 2), cand as (select * exclude (r) from (select *, row_number() over (partition by idea_id order by shared desc, node_id) r from sh) where r <= 100)"
_LCS = "(select coalesce(max(k), 0) from (select unnest(range(1, least(length(a), length(b)) + 1)) k) where len(list_intersect(list_transform(range(0, length(a) - k + 1), lambda i: substring(a, cast(i + 1 as int), cast(k as int))), list_transform(range(0, length(b) - k + 1), lambda i: substring(b, cast(i + 1 as int), cast(k as int))))) > 0)"

ORACLES = {
    "q_text_similarity": f"with {_DICT}, {_PAIR}, {_TOKA} select content, keyword, round({_tsim('content', 'keyword', 'ta', 'tb')}, 6) score from pt",
    "q_term_similarity": f"with {_PAIR}, k as (select content, keyword, {_KEY.format('content')} a, {_KEY.format('keyword')} b from pairs) select content, keyword, round(case when a = '' or b = '' then 0.0 when a = b then 1.0 when contains(a, b) or contains(b, a) then 0.95 else {_jac(_chars('a'), _chars('b'))} end, 6) score from k",
    "q_tfidf_topk": f"{_POST}, {_TF} " + _TOP.format("tf"),
    "q_jaccard_topk": f"{_POST}, {_KWJ} " + _TOP.format("kwj"),
    "q_hybrid_match": f"{_POST}, {_TF}, {_KWJ}, {_EMB}, pr as (select coalesce(tf.q, kwj.q) q, coalesce(tf.d, kwj.d) d, coalesce(kwj.score, 0) keyword, coalesce(tf.score, 0) tfidf from tf full join kwj on tf.q = kwj.q and tf.d = kwj.d), sm as (select a.doc_id q, b.doc_id d, least(1.0, greatest(-1.0, sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))))) semantic from emb a join emb b using (dim) where a.doc_id % 50 = 0 group by 1, 2), sc as (select pr.*, semantic, 0.2 * keyword + 0.3 * tfidf + 0.3 * semantic score from pr join sm on pr.q = sm.q and pr.d = sm.d) select q query_id, d doc_id, rank, round(keyword, 6) keyword, round(tfidf, 6) tfidf, round(semantic, 6) semantic, round(score, 6) score from (select *, row_number() over (partition by q order by round(score, 9) desc, d) rank from sc where score > 0) where rank <= 10",
    "q_stub_embedding": f"with {_EMB} select doc_id, cast(dim as int) dim, round(value, 6) \"value\" from emb",
    "q_vector_topk": "with e as (select vec_id, embedding::double[] v from embeddings), s as (select a.vec_id query_id, b.vec_id, list_cosine_similarity(a.v, b.v) score from e a, e b where a.vec_id % 50 = 0) select query_id, vec_id, rank, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s) where rank <= 10",
    "q_vector_upsert": "select vec_id, case when label = 3 then 99 else label end label, round((case when label = 3 then embedding[-1] else embedding[1] end)::double, 5) \"first\" from embeddings",
    "q_embedding_check": "select label, cast(min(len(embedding)) as int) min_dim, cast(max(len(embedding)) as int) max_dim, count(*) n from embeddings group by 1",
    "q_search": rf"""with b as (select doc_id, coalesce(raw_text, text) raw_text from documents), s as (select doc_id, raw_text, string_split_regex(raw_text, '{tx.PAGE_MARK.replace("(\\d+)", "[0-9]+")}') p, regexp_extract_all(raw_text, '{tx.PAGE_MARK}', 1) n from b where raw_text is not null),
m as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) page_ord, page, t from (select doc_id, i, case when i = 1 then 0 else cast(n[i - 1] as int) end page, regexp_replace(p[i], '^{_WS}+|{_WS}+$', '', 'g') t from (select *, unnest(range(1, len(p) + 1)) i from s where len(n) > 0)) where page > 0 or t <> ''),
q as (select doc_id, cast(i as int) page_ord, cast(i + 1 as int) page, substring(raw_text, cast(i * 2000 + 1 as int), 2000) t from (select *, unnest(range(greatest(1, cast(ceil(length(raw_text) / 2000.0) as int)))) i from s where len(n) = 0)),
pg as (select * from (select * from m union all select * from q) where contains(lower(t), 'equilibrium')),
h as (select doc_id, page_ord, page, t, pos from (select *, unnest(range(0, length(t) - 10)) pos from pg) where substring(lower(t), cast(pos + 1 as int), 11) = 'equilibrium'),
c as (select *, count(*) over (partition by doc_id, page_ord) score from h), f as (select * from c order by doc_id, page_ord, pos limit 50),
g as (select *, greatest(pos - 40, 0) lo, least(pos + 51, length(t)) hi from f)
select doc_id, page, cast(pos as int) match_index, case when lo > 0 then '...' else '' end || substring(t, cast(lo + 1 as int), cast(hi - lo as int)) || case when hi < length(t) then '...' else '' end snippet, cast(score as int) score, row_number() over (order by score desc, doc_id, page_ord, pos) rank from g""",
    "q_node_search": f"with {_NV}, s as (select node_id, content, weight, case when contains(lower(content), 'energy') then 1.0 when len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'energy'))) > 0 then 0.8 end::double score from nodes) select node_id, content, score from s where score is not null order by score desc, weight desc nulls last, node_id limit 20",
    "q_inverted_candidates": f"{_IDX} select * from cand",
    "q_auto_link": f"{_IDX}, p0 as (select idea_id, cand.node_id, qs.content a, it.content b, row_number() over () id from cand join qs on idea_id = qs.node_id join it on cand.node_id = it.node_id), ta as (select id, list(distinct token) t from {_dict_tokens('p0', 'a', 'id')} group by 1), tb as (select id, list(distinct token) t from {_dict_tokens('p0', 'b', 'id')} group by 1), pt as (select p0.*, coalesce(ta.t, []) ta, coalesce(tb.t, []) tb from p0 left join ta using (id) left join tb using (id)), sc as (select idea_id, node_id, {_tsim('a', 'b', 'ta', 'tb')} score from pt) select idea_id, node_id, round(score, 6) score, rank from (select *, row_number() over (partition by idea_id order by round(score, 9) desc, node_id) rank from sc where score >= 0.25) where rank <= 10",
    "q_keyword_overlap": f"with {_DICT}, {_PAIR}, a as (select id, token w, count(*) c1 from {_dict_tokens('pairs', 'content', 'id')} group by 1, 2), b as (select id, token w, count(*) c2 from {_dict_tokens('pairs', 'keyword', 'id')} group by 1, 2) select content, keyword, round(sum(case when c2 is null then 0 else least(c1, c2) end) / sum(c1), 6) overlap from a left join b on a.id = b.id and a.w = b.w join pairs on pairs.id = a.id group by 1, 2",
}
