"""Queries over the property graph, structure, incremental change and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.operators import graph as g
from quillgraph.operators import hierarchy as hi
from quillgraph.plans.q_match import _NV, _nodes
from quillgraph.plans.q_terms import _DICT, _SENT, _dict_tokens, _docs, _terms
from quillgraph.plans.q_text import _heads
from quillgraph.plans.shared import table
from quillgraph.streaming.rate_limit import rate_limit as limit_requests

SEED = "n00000000002"


def _edges(spark, d):
    return table(spark, d, "graph_edges")


def _adj(spark, d):
    return g.adjacency(g.upsert_edges(_edges(spark, d)), _nodes(spark, d))


def edge_upsert(spark, d):
    return g.upsert_edges(_edges(spark, d)).select("from_id", "to_id", "edge_type", "weight", "link_method")


def edge_validate(spark, d):
    return g.valid_edges(g.upsert_edges(_edges(spark, d)), _nodes(spark, d)).select("from_id", "to_id", "edge_type", "weight")


def node_repair(spark, d):
    return g.repair_nodes(_nodes(spark, d)).select("node_id", "node_type", "content", "weight")


def adjacency(spark, d):
    return _adj(spark, d)


def remove_cascade(spark, d):
    n = _nodes(spark, d)
    return g.remove_nodes(n, g.upsert_edges(_edges(spark, d)), n.where("node_type = 'idea'"))[1].select("from_id", "to_id", "edge_type")


def graph_stats(spark, d):
    return g.stats(_nodes(spark, d), g.upsert_edges(_edges(spark, d)))


def pagerank(spark, d):
    return g.pagerank(_adj(spark, d), _nodes(spark, d)).select("node_id", F.round(F.col("rank") * 1000, 6).alias("rank"))


def ppr(spark, d):
    """From the node of the greatest out-degree."""
    a = _adj(spark, d)
    seed = a.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    return g.personalized_pagerank(a, _nodes(spark, d), seed, 10, stop=0.0).where("rank > 0").select("node_id", F.round("rank", 6).alias("rank"))


def common_neighbors(spark, d):
    """For the two ends of every edge."""
    a = _adj(spark, d)
    return g.common_neighbors(a, a.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())


def k_hop(spark, d):
    """Everything within three links of any document node of the nodes' first document."""
    n = _nodes(spark, d)
    seeds = n.where("node_type = 'document'").select("node_id")
    return g.k_hop(_adj(spark, d), seeds, 3)


def communities(spark, d):
    return g.label_propagation(_adj(spark, d), _nodes(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


def heading_tree(spark, d):
    return hi.heading_links(table(spark, d, "headings"))


def heading_of_offset(spark, d):
    """Deepest heading at the start of every line of every raw text, at every bound of a heading, where alone the
    answer can change, and at every 500th character, where the SQL asks."""
    docs, h = table(spark, d, "documents").where("length(raw_text) > 0"), _heads(spark, d)
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("raw_text").cast("bigint") - 1, F.lit(500).cast("bigint"))).alias("pos"))
    lines = docs.select("doc_id", F.explode(tx.line_starts(F.col("raw_text"))).alias("pos"))
    bounds = h.select("doc_id", F.explode(F.array("start_pos", "end_pos")).alias("pos")).join(docs.select("doc_id", F.length("raw_text").alias("n")), "doc_id").where("0 <= pos and pos < n").select("doc_id", "pos")
    return g.heading_at(points.unionByName(lines).unionByName(bounds).distinct(), h)


def sections(spark, d):
    """Chapter and section numbers of every heading, with the length of its own text."""
    w = Window.partitionBy("doc_id").orderBy("ord", "start_pos", "heading_id")
    h = _heads(spark, d).where("start_pos is not null").select("heading_id", "doc_id", "ord", "start_pos", "heading_level", F.sum((F.col("heading_level") == 1).cast("int")).over(w).alias("chapter"), F.lead("start_pos").over(w).alias("next"))
    h = h.withColumn("section", F.sum((F.col("heading_level") == 2).cast("int")).over(Window.partitionBy("doc_id", "chapter").orderBy("ord", "start_pos", "heading_id")))
    docs = table(spark, d, "documents").select("doc_id", F.length("raw_text").alias("len"))
    return h.join(docs, "doc_id").select("heading_id", "chapter", "section", (F.coalesce("next", "len") - F.col("start_pos")).alias("n"))


def pattern_relations(spark, d):
    c = _docs(spark, d).select(F.explode(tk.clauses(F.col("text"))).alias("clause")).where("length(clause) >= 10")
    return g.pattern_relations(c, "clause")


def cooccur_edges(spark, d):
    """Dictionary terms of one sentence."""
    t = _terms(spark, d)
    s = _docs(spark, d).select("doc_id", F.posexplode(tk.sentences(F.col("text"))).alias("ord", "s"))
    u = s.select(F.concat_ws("/", "doc_id", "ord").alias("unit"), F.explode(tk.dict_tokens(F.col("s"), t)).alias("entity")).where(F.col("entity").isin(t))
    return g.cooccurrence(u, "unit", "entity")


def incremental_rebuild(spark, d):
    """The graph after the documents of project 5 are delivered again with their entities only."""
    n, e = _nodes(spark, d), g.upsert_edges(_edges(spark, d)).select("from_id", "to_id", "edge_type", "weight")
    docs = table(spark, d, "documents").where("project_id = 5").select("doc_id")
    new = n.where("node_type = 'entity'").join(docs, "doc_id", "left_semi")
    nodes, edges = g.rebuild_documents(n, e, docs, new, e)
    return edges.select("from_id", "to_id", "edge_type")


def doc_delete(spark, d):
    """Nodes left when every document without a source is deleted with its graph."""
    gone = table(spark, d, "documents").where("source is null").select("doc_id")
    n = _nodes(spark, d)
    return g.remove_nodes(n, _edges(spark, d), n.join(gone, "doc_id", "left_semi"))[0].groupBy("node_type").agg(F.count("*").alias("n"))


def reorder(spark, d):
    return g.reorder(table(spark, d, "projects").select("project_id"), "project_id", [7, 3, 30, 1])


def project_list(spark, d):
    """Projects with their number of documents and of ideas, latest change first."""
    docs = table(spark, d, "documents").select("doc_id", "project_id").where("project_id is not null")
    ideas = _nodes(spark, d).where("node_type = 'idea'").select("doc_id").join(docs, "doc_id").groupBy("project_id").agg(F.count("*").alias("n_ideas"))
    p = table(spark, d, "projects").join(docs.groupBy("project_id").agg(F.count("*").alias("n_documents")), "project_id", "left").join(ideas, "project_id", "left")
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("updated_at"), "project_id"))
    return p.select("project_id", "project_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_ideas", F.lit(0)).alias("n_ideas"), rank.alias("rank"))


def log_ring(spark, d):
    """The latest 200 events of every type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 200").select("event_type", "rank", "event_id", "value")


def rate_limit(spark, d):
    return limit_requests(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 86_400, 2)


def event_windows(spark, d):
    """Events and their values by type and hour."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", "total")


QUERIES = {f"q_{f.__name__}": f for f in (edge_upsert, edge_validate, node_repair, adjacency, remove_cascade, graph_stats, pagerank, ppr, common_neighbors, k_hop, communities, heading_tree, heading_of_offset, sections, pattern_relations, cooccur_edges, incremental_rebuild, doc_delete, reorder, project_list, log_ring, rate_limit, event_windows)}

# -- SQL ---------------------------------------------------------------------------------------------
_UND = ", ".join(f"'{x}'" for x in g.UNDIRECTED)
_TYPES = ", ".join(f"'{x}'" for x in g.EDGE_TYPES)
_E = f"ek as (select *, case when edge_type in ({_UND}) then least(from_id, to_id) || '|' || greatest(from_id, to_id) else from_id || '|' || to_id end k from graph_edges where from_id is not null and to_id is not null and edge_type is not null), er as (select *, max(weight) over (partition by k, edge_type) mw, row_number() over (partition by k, edge_type order by ingested_at, from_id, to_id, link_method nulls first) rn from ek), e as (select from_id, to_id, edge_type, mw weight, link_method from er where rn = 1)"
_V = f"{_NV}, {_E}, ve as (select * from e where edge_type in ({_TYPES}) and from_id in (select node_id from nodes) and to_id in (select node_id from nodes))"
_A = f"{_V}, adj as (select from_id src, to_id dst, edge_type, coalesce(weight, 1.0) weight from ve union all select to_id, from_id, edge_type, coalesce(weight, 1.0) from ve where edge_type in ({_UND}))"
_HV = "hv as (select *, row_number() over (partition by heading_id order by ingested_at desc) rn from headings where heading_id is not null), h as (select * from hv where rn = 1)"


def _pagerank_sql(rounds: int = 30) -> str:
    steps = "".join(
        f", r{k} as materialized (select i.node_id, i.dangling, 0.15 / i.n + 0.85 * (coalesce(m.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where dangling) / i.n) rank from base i left join (select dst, sum(rank * share) got from r{k - 1} join lk on node_id = src group by 1) m on m.dst = i.node_id)"
        for k in range(1, rounds + 1)
    )
    return f"with {_A}, tot as (select src, sum(weight) t from adj group by 1), lk as materialized (select adj.src, dst, sum(weight) / any_value(t) share from adj join tot on adj.src = tot.src where t > 0 group by 1, 2), base as materialized (select node_id, node_id not in (select src from lk) dangling, (select count(*) from nodes) n from nodes), r0 as (select node_id, dangling, 1.0::double / n rank from base)" + steps + f" select node_id, round(rank * 1000, 6) rank from r{rounds}"


def _ppr_sql(rounds: int = 10) -> str:
    steps = "".join(
        f", r{k} as materialized (select i.node_id, i.dangling, 0.85 * (coalesce(m.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where dangling) / i.n) + case when i.node_id = (select s from seed) then 0.15 else 0.0 end rank from base i left join (select dst, sum(rank * share) got from r{k - 1} join lk on node_id = src group by 1) m on m.dst = i.node_id)"
        for k in range(1, rounds + 1)
    )
    return f"with {_A}, deg as (select src, count(*) d from adj group by 1), seed as (select src s from deg order by d desc, src limit 1), lk as materialized (select adj.src, dst, 1.0::double / d share from adj join deg on adj.src = deg.src), base as materialized (select node_id, node_id not in (select src from lk) dangling, (select count(*) from nodes) n from nodes), r0 as (select node_id, dangling, case when node_id = (select s from seed) then 1.0::double else 0.0 end rank from base)" + steps + f" select node_id, round(rank, 6) rank from r{rounds} where rank > 0"


def _hop_sql(k: int = 3) -> str:
    steps = ""
    for n in range(1, k + 1):
        before = " union all ".join(f"select node_id from f{m}" for m in range(n))
        steps += f", f{n} as materialized (select dst node_id, {n} depth, min(src) via from f{n - 1} join ae on f{n - 1}.node_id = ae.src where dst not in ({before}) group by 1)"
    return f"with {_A}, ae as (select distinct src, dst from adj), f0 as (select node_id, 0 depth, null::varchar via from nodes where node_type = 'document')" + steps + " " + " union all ".join(f"select * from f{n}" for n in range(1, k + 1))


_REL = " union all ".join(f"select regexp_extract(clause, '{p}', {a}) src, regexp_extract(clause, '{p}', {b}) dst, '{k}' kind, {w}::double weight from c" for p, ends in g.RELATION_FORMS for a, b, k, w in ends)
ORACLES = {
    "q_edge_upsert": f"with {_E} select * from e",
    "q_edge_validate": f"with {_V} select from_id, to_id, edge_type, weight from ve",
    "q_node_repair": f"with {_NV} select node_id, case when node_type in ({', '.join(repr(x) for x in g.NODE_TYPES)}) then node_type else 'concept' end node_type, case when trim(coalesce(content, ''), ' ') = '' then coalesce(keyword, node_id) else content end content, coalesce(weight, 0.5) weight from nodes",
    "q_adjacency": f"with {_A} select * from adj",
    "q_remove_cascade": f"with {_NV}, {_E}, x as (select node_id from nodes where node_type = 'idea') select from_id, to_id, edge_type from e where from_id not in (select node_id from x) and to_id not in (select node_id from x)",
    "q_graph_stats": f"with {_NV}, {_E} select 'node' what, node_type kind, count(*) n from nodes group by 2 union all select 'edge', edge_type, count(*) from e group by 2",
    "q_pagerank": _pagerank_sql(),
    "q_ppr": _ppr_sql(),
    "q_common_neighbors": f"with {_A}, nb as (select distinct src, dst from adj), c as (select p.src a, p.dst b, count(*) common from nb p join nb x on x.src = p.src join nb y on y.src = p.dst and y.dst = x.dst group by 1, 2) select nb.src a, nb.dst b, coalesce(common, 0) common from nb left join c on a = nb.src and b = nb.dst",
    "q_k_hop": _hop_sql(),
    "q_heading_tree": f"with {_HV}, flat as (select doc_id from h group by 1 having count(children) = 0) select distinct u.child, u.parent from (select heading_id parent, unnest(children) child from h) u where u.child in (select heading_id from h) union all select child, parent from (select c.heading_id child, (select arg_max(p.heading_id, p.ord) from h p where p.doc_id = c.doc_id and p.ord < c.ord and p.heading_level < c.heading_level) parent from h c where c.doc_id in (select doc_id from flat)) where parent is not null",
    "q_heading_of_offset": f"with {_HV}, p as (select distinct doc_id, pos from (select doc_id, unnest(range(0, length(raw_text), 500)) pos from documents where length(raw_text) > 0 union all select doc_id, pos from (select doc_id, unnest(ls) l, unnest(list_transform(range(len(ls)), lambda i: list_sum(list_transform(ls[:i], lambda x: length(x) + 1)))) p0, coalesce(p0, 0) pos from (select doc_id, string_split(raw_text, chr(10)) ls from documents where length(raw_text) > 0)) where l <> '' union all select h.doc_id, b.pos from (select doc_id, unnest([start_pos, end_pos]) pos from h) b join documents h on h.doc_id = b.doc_id where length(raw_text) > 0 and 0 <= b.pos and b.pos < length(raw_text))), r as (select p.doc_id, pos, heading_id, row_number() over (partition by p.doc_id, pos order by heading_level desc, start_pos desc, heading_id desc) k from p join h on p.doc_id = h.doc_id and end_pos > start_pos and start_pos <= pos and pos < end_pos) select doc_id, pos, heading_id from r where k = 1",
    "q_sections": f"with {_HV}, c as (select *, sum(cast(heading_level = 1 as int)) over w chapter, lead(start_pos) over w nxt from h where start_pos is not null window w as (partition by doc_id order by ord, start_pos, heading_id)), s as (select *, sum(cast(heading_level = 2 as int)) over (partition by doc_id, chapter order by ord, start_pos, heading_id) section from c) select heading_id, cast(chapter as bigint) chapter, cast(section as bigint) section, coalesce(nxt, length(raw_text)) - start_pos n from s join documents using (doc_id)",
    "q_pattern_relations": f"with c as (select clause from (select unnest(string_split_regex(text, '[。；;]')) clause from documents where text <> '') where length(clause) >= 10), r as ({_REL}) select src, dst, kind, max(weight) weight, count(*) n from r where src <> '' and dst <> '' and src <> dst group by 1, 2, 3",
    "q_cooccur_edges": f"with {_DICT}, docs as (select doc_id, text from documents where text <> ''), st as (select doc_id || '/' || i unit, s[i + 1] s from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, {_SENT} s from docs))), tok as (select distinct unit, token from {_dict_tokens('st', 's', 'unit')} where token in (select t from dict2)), u as (select * from (select *, row_number() over (partition by unit order by length(token) desc, token) r from tok) where r <= 10) select x.token a, y.token b, count(*) n, least(count(*), 5) weight from u x join u y on x.unit = y.unit and x.token < y.token group by 1, 2",
    "q_incremental_rebuild": f"with {_V}, dd as (select doc_id from documents where project_id = 5), kept as (select node_id from nodes where not (coalesce(node_type, '') <> 'document' and coalesce(doc_id in (select doc_id from dd), false) and node_type is not null) or node_type = 'entity') select from_id, to_id, edge_type from e where edge_type in ({_TYPES}) and from_id in (select node_id from kept) and to_id in (select node_id from kept)",
    "q_doc_delete": f"with {_NV} select node_type, count(*) n from nodes where doc_id is null or doc_id not in (select doc_id from documents where source is null) group by 1",
    "q_reorder": "select project_id, cast(row_number() over (order by case project_id when 7 then 1 when 3 then 2 when 30 then 3 when 1 then 4 else 2147483648 end, project_id) as int) ord from projects",
    "q_project_list": f"with {_NV}, dc as (select project_id, count(*) n_documents from documents where project_id is not null group by 1), ic as (select project_id, count(*) n_ideas from nodes join documents using (doc_id) where node_type = 'idea' and project_id is not null group by 1) select project_id, project_name, coalesce(n_documents, 0) n_documents, coalesce(n_ideas, 0) n_ideas, row_number() over (order by updated_at desc nulls last, project_id) rank from projects left join dc using (project_id) left join ic using (project_id)",
    "q_log_ring": 'select event_type, rank, event_id, "value" from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) rank from events) where rank <= 200',
    "q_rate_limit": "with recursive k as (select user_id, event_type, min(ts) s from events group by 1, 2), w as (select * from k union all select w.user_id, w.event_type, (select min(e.ts) from events e where e.user_id = w.user_id and e.event_type = w.event_type and e.ts >= w.s + interval 1 day) from w where w.s is not null), v as (select * from w where s is not null), a as (select e.user_id, e.event_type, e.event_id, e.ts, max(v.s) s from events e join v on v.user_id = e.user_id and v.event_type = e.event_type and v.s <= e.ts group by 1, 2, 3, 4) select user_id, event_type, event_id, row_number() over (partition by user_id, event_type, s order by ts, event_id) <= 2 allowed from a",
    "q_event_windows": "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') \"hour\", count(*) n, round(sum(\"value\"), 4) total from events group by 1, 2",
}
