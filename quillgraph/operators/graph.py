"""Property graph: upsert, repair, adjacency, ranking, traversal and incremental change."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.shared import materialize

# Kinds of nodes and edges.
NODE_TYPES = ["concept", "entity", "heading", "document", "idea", "manual"]
UNDIRECTED = ["similar", "related", "cross-link", "co-occurrence", "semantic", "relates", "also-known-as"]
EDGE_TYPES = ["manual", *UNDIRECTED, "belong", "contains", "hierarchy", "includes", "idea-hierarchy", "idea-link", "is", "of", "affects", "refers-to", "enables", "examines", "derive", "cite"]


def edge_key(f: str = "from_id", t: str = "to_id", kind: str = "edge_type") -> Column:
    """One key for an edge; undirected kinds ignore orientation."""
    a, b = F.col(f), F.col(t)
    und = F.col(kind).isin(UNDIRECTED)
    return F.concat_ws("|", F.when(und, F.least(a, b)).otherwise(a), F.when(und, F.greatest(a, b)).otherwise(b), F.col(kind))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row per edge_key: the orientation and method of the first (by ingested_at, then ends), the greatest weight.

    Null ends and types are dropped; a null weight counts only where all are null.
    """
    e = edges.where("from_id is not null and to_id is not null and edge_type is not null").withColumn("k", edge_key())
    first = F.min(F.struct("ingested_at", "from_id", "to_id", "link_method")).alias("f")
    return e.groupBy("k", "edge_type").agg(first, F.max("weight").alias("weight")).select("f.from_id", "f.to_id", "edge_type", "weight", "f.link_method", F.col("f.ingested_at").alias("ingested_at"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a known type whose ends both have a row."""
    ids = nodes.select("node_id").distinct()
    e = edges.where(F.col("edge_type").isin(EDGE_TYPES))
    e = e.join(ids, F.col("from_id") == F.col("node_id"), "left_semi")
    return e.join(ids, F.col("to_id") == F.col("node_id"), "left_semi")


def repair_nodes(nodes: DataFrame) -> DataFrame:
    """Unknown types become concept, blank contents the keyword or the id, null weights 0.5."""
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    kind = F.when(F.col("node_type").isin(NODE_TYPES), F.col("node_type")).otherwise("concept")
    return nodes.withColumns({"node_type": kind, "content": F.when(blank, F.coalesce("keyword", "node_id")).otherwise(F.col("content")), "weight": F.coalesce("weight", F.lit(0.5))})


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, edge_type, weight: every valid edge forward, undirected ones backward too."""
    e = valid_edges(edges, nodes).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_type", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    both = e.select(F.explode(F.when(F.col("edge_type").isin(UNDIRECTED), F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).otherwise(F.array(F.struct("src", "dst")))).alias("s"), "edge_type", "weight")
    return both.select("s.src", "s.dst", "edge_type", "weight")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the given node_ids and the edges that touch them."""
    g = gone.select("node_id").distinct()
    left = edges.join(g, F.col("from_id") == F.col("node_id"), "left_anti").join(g, F.col("to_id") == F.col("node_id"), "left_anti")
    return nodes.join(g, "node_id", "left_anti"), left


def rebuild_documents(nodes: DataFrame, edges: DataFrame, doc_ids: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the graph of some documents: their nodes but the document nodes go with all dangling edges, then new
    nodes are added by id and new edges by key."""
    gone = nodes.where("node_type <> 'document'").join(doc_ids, "doc_id", "left_semi").select("node_id")
    n, e = remove_nodes(nodes, edges, gone)
    n = n.unionByName(new_nodes.join(n.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)
    have = e.select(edge_key().alias("k"))
    add = new_edges.withColumn("k", edge_key()).join(have, "k", "left_anti").drop("k")
    return n, valid_edges(e.unionByName(add, allowMissingColumns=True), n)


def pagerank(adj: DataFrame, nodes: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """node_id, rank: weighted, every node starts at 1 / n, dangling rank is spread evenly; ranks add up to 1.

    The links are written once; the ranks, which every round uses twice, are written each round.
    """
    ids = materialize(nodes.select("node_id").distinct(), "rank-nodes")
    n = ids.count()
    out = adj.groupBy("src").agg(F.sum("weight").alias("total"))
    links = materialize(adj.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").where("total > 0").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-links")
    base = materialize(ids.join(links.select(F.col("src").alias("node_id")).distinct().withColumn("live", F.lit(True)), "node_id", "left").select("node_id", F.col("live").isNull().alias("dangling")), "rank-base")
    rank = base.withColumn("rank", F.lit(1.0 / max(1, n)))
    for k in range(1, iterations + 1):
        moved = rank.join(links, rank.node_id == links.src).groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        rank = base.join(moved, "node_id", "left").join(F.broadcast(lost)).select("node_id", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = materialize(rank, "rank")
    return rank.select("node_id", "rank")


def personalized_pagerank(adj: DataFrame, nodes: DataFrame, seed: str, iterations: int = 20, alpha: float = 0.85, stop: float = 1e-6) -> DataFrame:
    """node_id, rank from a walk that returns to the seed: unweighted, parallel edges count each; a dangling node
    spreads evenly. Ends early when no more than `stop` changes in all."""
    ids = materialize(nodes.select("node_id").distinct(), "ppr-nodes")
    n = ids.count()
    deg = adj.groupBy("src").agg(F.count("*").alias("deg"))
    links = materialize(adj.join(deg, "src").select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("share")), "ppr-links")
    base = materialize(ids.join(deg.select(F.col("src").alias("node_id"), F.lit(True).alias("live")), "node_id", "left").select("node_id", F.col("live").isNull().alias("dangling")), "ppr-base")
    rank = base.withColumn("rank", F.when(F.col("node_id") == seed, 1.0).otherwise(0.0))
    for k in range(1, iterations + 1):
        moved = rank.where("rank > 0").join(links, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        nxt = rank.select("node_id", "dangling", F.col("rank").alias("before")).join(moved, F.col("node_id") == F.col("to"), "left").join(F.broadcast(lost))
        nxt = nxt.select("node_id", "dangling", "before", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + F.when(F.col("node_id") == seed, 1 - alpha).otherwise(0.0)).alias("rank"))
        nxt = materialize(nxt, "ppr")
        if k % 5 == 0 or k == iterations:
            if nxt.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < stop:
                return nxt.select("node_id", "rank")
        rank = nxt.drop("before")
    return rank.select("node_id", "rank")


def common_neighbors(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common: distinct neighbours shared by the two ends of every given pair."""
    nb = adj.select("src", "dst").distinct()
    j = pairs.join(nb.select(F.col("src").alias("a"), F.col("dst").alias("x")), "a").join(nb.select(F.col("src").alias("b"), F.col("dst").alias("x")), ["b", "x"])
    return pairs.join(j.groupBy("a", "b").agg(F.count("*").alias("common")), ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def k_hop(adj: DataFrame, seeds: DataFrame, k: int | None) -> DataFrame:
    """node_id, depth, via: every node within k links of a seed (node_id), by the fewest; via is the smallest node one
    link before it. Seeds are left out; k None goes on until nothing new is reached. Only the frontier is joined in each step."""
    edges = materialize(adj.select("src", "dst").distinct(), "hop-edges")
    seen = seeds.select("node_id").distinct().withColumns({"depth": F.lit(0), "via": F.lit(None).cast("string")})
    front, all_ = seen, seen
    for depth in count(1) if k is None else range(1, k + 1):
        nxt = front.join(edges, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("via"))
        nxt = nxt.join(all_.select(F.col("node_id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node_id"), F.lit(depth).alias("depth"), "via")
        front = materialize(nxt, "hop")
        if front.isEmpty():
            break
        all_ = all_.unionByName(front)
    return all_.where("depth > 0")


def shortest_path(adj: DataFrame, a: str, b: str, most: int | None = None) -> list[str] | None:
    """Nodes of a shortest path from a to b, None if there is none, or none within `most` links where that is given."""
    spark = adj.sparkSession
    if a == b:
        return [a]
    hops = materialize(k_hop(adj, spark.createDataFrame([(a,)], "node_id string"), most), "path-hops")
    path, at = [b], b
    while at != a:
        row = hops.where(F.col("node_id") == at).select("via").first()
        if row is None:
            return None
        at = row[0]
        path.append(at)
    return path[::-1]


def label_propagation(adj: DataFrame, nodes: DataFrame, iterations: int = 50) -> DataFrame:
    """node_id, community: every round a node takes the label of greatest weight around it, ties to the smallest; a
    node without links keeps its own. An undirected edge, which adj holds both ways, counts once.

    The nodes move in two halves, drawn anew every round by a hash; the second sees the labels of the first, so
    neighbours do not exchange labels for ever. Deterministic; ends when a round changes nothing. A community is
    named by its smallest node.
    """
    w = F.when(F.col("edge_type").isin(UNDIRECTED), F.col("weight") / 2).otherwise(F.col("weight"))
    one = adj.where("src <> dst").select("src", "dst", w.alias("w"))
    both = materialize(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "lpa-links")
    label = nodes.select("node_id").distinct().withColumn("community", F.col("node_id"))
    for k in range(iterations):
        still = True
        for half in (0, 1):
            turn = both.where(F.pmod(F.xxhash64(F.lit(k), "src"), F.lit(2)) == half)
            votes = turn.join(label, F.col("dst") == F.col("node_id")).groupBy("src", "community").agg(F.round(F.sum("w"), 9).alias("w"))
            best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b")).select("src", F.col("b.community").alias("new"))
            new = F.coalesce("new", "community")
            nxt = materialize(label.join(best, F.col("node_id") == F.col("src"), "left").select("node_id", new.alias("community"), (new != F.col("community")).alias("moved")), "lpa")
            label = nxt.select("node_id", "community")
            still = still and nxt.where("moved").isEmpty()
        if still:
            break
    name = label.groupBy("community").agg(F.min("node_id").alias("name"))
    return label.join(name, "community").select("node_id", F.col("name").alias("community"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), kind, n."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).count().unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).count()).withColumnRenamed("count", "n")


def heading_at(points: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, pos, heading_id: the deepest heading whose range holds a point, ties to the later start, then the greater id.

    Points and heading starts of a document are sorted together and swept once; only the ranges still open are held.
    Points in no range, and null doc_ids and positions, have no row.
    """
    h = headings.where("end_pos > start_pos and doc_id is not null").select("doc_id", F.col("start_pos").cast("bigint").alias("pos"), F.lit(0).alias("kind"), F.col("heading_level").alias("level"), F.col("end_pos").cast("bigint").alias("end_pos"), "heading_id")
    p = points.where("doc_id is not null and pos is not null").select("doc_id", F.col("pos").cast("bigint").alias("pos")).distinct()
    p = p.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("end_pos"), F.lit(None).cast("string").alias("heading_id"))
    both = h.unionByName(p).repartition("doc_id").sortWithinPartitions("doc_id", "pos", "kind")
    return both.mapInPandas(_sweep, "doc_id bigint, pos bigint, heading_id string")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc, still = None, []
    for pdf in batches:
        out = []
        for d, pos, kind, level, end, key in zip(*(pdf[c].tolist() for c in ("doc_id", "pos", "kind", "level", "end_pos", "heading_id"))):
            if d != doc:
                doc, still = d, []
            if kind == 0:
                still.append((-1 if level != level or level is None else level, pos, key, end))
                continue
            still = [x for x in still if x[3] > pos]
            if still:
                out.append((d, pos, max(still)[2]))
        yield pd.DataFrame(out, columns=["doc_id", "pos", "heading_id"])


def reorder(items: DataFrame, key: str, order: list) -> DataFrame:
    """Adds ord: listed keys first in the given order, the rest after by key."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key)) if order else F.lit(0)
    return items.withColumn("ord", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(F.lit(2**31)), key)))


# -- relations read from text ----------------------------------------------------------------------------
_E = "([一-龥]{2,})"
#: What a clause must hold for each form to be tried: a backtracking search over long unspaced runs is slow.
RELATION_GUARDS = ["是.*的", "分[为成].*[和与、]", "包括|包含|含有|组成|构成", "与.*的(?:关系|区别|联系|比较|差异|异同|关联|相互)", "对.*的", "的简称", "叫作|称为|名为|称做"]
# Sentence forms, the groups of their ends, the kind of edge and its weight.
RELATION_FORMS = [
    (f"{_E}是([一-龥]{{1,10}})的{_E}", [(1, 3, "is", 2.0), (2, 3, "of", 1.5)]),
    (f"{_E}分[为成]{_E}[和与、]{_E}", [(1, 2, "includes", 1.8), (1, 3, "includes", 1.8)]),
    (f"{_E}(?:包括|包含|含有|由.+组成|由.+构成){_E}", [(1, 2, "includes", 1.5)]),
    (f"{_E}与{_E}的(?:关系|区别|联系|比较|差异|异同|关联|相互作用|相互影响)", [(1, 2, "relates", 2.0)]),
    (f"{_E}对{_E}的{_E}", [(1, 3, "affects", 1.5), (2, 3, "of", 1.2)]),
    (f"{_E}是{_E}的简称", [(2, 1, "refers-to", 1.5)]),
    (f"{_E}(?:叫作|称为是|称为|名为|称做){_E}", [(1, 2, "also-known-as", 1.5)]),
]


def pattern_relations(clauses: DataFrame, clause: str, *keys: str) -> DataFrame:
    """[keys,] src, dst, kind, weight, n: ends found by the first match of each form in every clause, counted over all."""
    none = F.array().cast("array<struct<src:string,dst:string,kind:string,weight:double>>")
    found = [
        F.when(F.col(clause).rlike(guard), F.array(*[F.struct(F.regexp_extract(clause, p, a).alias("src"), F.regexp_extract(clause, p, b).alias("dst"), F.lit(k).alias("kind"), F.lit(w).alias("weight")) for a, b, k, w in ends])).otherwise(none)
        for guard, (p, ends) in zip(RELATION_GUARDS, RELATION_FORMS)
    ]
    r = clauses.select(*keys, F.explode(F.concat(*found)).alias("r")).select(*keys, "r.*").where("src <> '' and dst <> '' and src <> dst")
    return r.groupBy(*keys, "src", "dst", "kind").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


def cooccurrence(units: DataFrame, unit: str, entity: str, most: int = 10, cap: int = 5) -> DataFrame:
    """a, b, n, weight: entities of one unit in pairs a < b; of a unit the `most` longest entities count; weight is at most cap."""
    u = units.select(unit, entity).distinct()
    u = u.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(F.length(entity)), entity))).where(F.col("_r") <= most)
    j = u.select(unit, F.col(entity).alias("a")).join(u.select(unit, F.col(entity).alias("b")), unit).where("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("weight", F.least("n", F.lit(cap)))
