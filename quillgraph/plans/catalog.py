"""Queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import hierarchy as hi
from quillgraph.plans import q_build, q_graph, q_match, q_terms, q_text
from quillgraph.plans.shared import table


def _trees(spark: SparkSession, sf_dir: str, with_paths: bool = False) -> DataFrame:
    return hi.document_trees(*(table(spark, sf_dir, t) for t in ("headings", "graph_nodes", "graph_edges")), with_paths)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir)


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, True).select("item_id", "root_id", "link_depth", F.coalesce(F.array_join("path", "/"), F.lit("-")).alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants and greatest distance to one, per item that has any."""
    return hi.descendants(_trees(spark, sf_dir, True)).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"), F.max("distance").cast("bigint").alias("height"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
}

_P5 = """
with recursive hv as (select *, row_number() over (partition by heading_id order by ingested_at desc) rn from headings where heading_id is not null),
h as (select * from hv where rn = 1),
flat as (select doc_id from h group by 1 having count(children) = 0),
hl as (select distinct u.child, u.parent from (select heading_id parent, unnest(children) child from h) u where u.child in (select heading_id from h)
  union select c.heading_id, (select arg_max(p.heading_id, p.ord) from h p where p.doc_id = c.doc_id and p.ord < c.ord and p.heading_level < c.heading_level) from h c where c.doc_id in (select doc_id from flat)),
n as (select distinct node_id from graph_nodes),
el as (select distinct case when edge_type = 'belong' then from_id else to_id end child, case when edge_type = 'belong' then to_id else from_id end parent from graph_edges
  where edge_type in ('contains', 'hierarchy', 'includes', 'idea-hierarchy', 'belong')),
l as (select 'h' || child child, 'h' || parent parent from hl where parent is not null
  union select 'n' || child, 'n' || parent from el where child in (select node_id from n) and parent in (select node_id from n)),
w as (select child item, parent anc, 1 d, [parent, child] path from l union all select w.item, l.parent, w.d + 1, list_prepend(l.parent, w.path) from w join l on w.anc = l.child where w.d < 60),
cyc as (select distinct item from w where d >= 60),
top as (select item, anc, d, path, row_number() over (partition by item order by d desc, anc) rn from w where anc not in (select child from l)),
r as (select i.item, t.anc, t.d, t.path, c.item is not null cyclic from (select distinct child item from l) i left join cyc c using (item) left join top t on t.item = i.item and t.rn = 1)
"""
ORACLES: dict[str, str] = {
    "p5_found": _P5 + "select substr(item, 2) item_id, case when cyclic then '-' else substr(anc, 2) end root_id, cast(case when cyclic then -1 else d end as bigint) link_depth from r",
    "p5_paths": _P5 + "select substr(item, 2) item_id, case when cyclic then '-' else substr(anc, 2) end root_id, cast(case when cyclic then -1 else d end as bigint) link_depth, case when cyclic then '-' else array_to_string(list_transform(path, lambda x: substr(x, 2)), '/') end path from r",
    "p5_descendants": _P5 + ", e as (select item, unnest(path) anc, unnest(range(len(path) - 1, -1, -1)) dist from r where not cyclic) select substr(anc, 2) ancestor_id, count(*) n_descendants, max(dist) height from e where dist > 0 group by 1",
}

for _part in (q_text, q_terms, q_match, q_graph, q_build):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid match of the query documents against all documents."""
    return q_match.hybrid_match(spark, sf_dir).orderBy("query_id", "rank")
