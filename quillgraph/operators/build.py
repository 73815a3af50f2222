"""Building the graph of documents: heading and entity nodes, links between sections and documents, display values."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import similarity as sim
from quillgraph.functions import tokens as tk
from quillgraph.functions.text import link_form
from quillgraph.operators import document_pass as dp
from quillgraph.operators import graph as g
from quillgraph.operators.alike import SLACK, alike_texts, candidates, text_candidates, text_rules
from quillgraph.operators.hierarchy import heading_links, hierarchy
from quillgraph.plans.shared import latest, materialize

# Weights of generated edges and sizes of nodes.
HIERARCHY_WEIGHT, CONTAINS_WEIGHT = 3.0, 1.5
TYPE_ORDER = ["document", "heading", "concept", "entity", "idea", "manual"]


def heading_graph(headings: DataFrame) -> DataFrame:
    """node_id, parent_id, weight, size, edge_weight of every counted heading: weight 5 - level, size 18 - 3 * level, and a
    `hierarchy` edge from its parent where it has one. A null level counts as 3."""
    h = latest(headings.select("heading_id", "heading_level", "ingested_at"), "heading_id", "ingested_at")
    links = heading_links(headings)
    level = F.coalesce("heading_level", F.lit(3))
    out = h.join(links, F.col("heading_id") == F.col("child"), "left")
    return out.select(F.col("heading_id").alias("node_id"), F.col("parent").alias("parent_id"), (5 - level).alias("weight"), (18 - 3 * level).alias("size"), F.when(F.col("parent").isNotNull(), HIERARCHY_WEIGHT).alias("edge_weight"))


def entity_scores(paragraphs: DataFrame, entities: DataFrame, top: int = 80) -> DataFrame:
    """doc_id, content, df, total, rank of the `top` entities of every document: score * (1 + ln(df + 1)), where df counts
    the paragraphs (doc_id, p) that hold the entity (doc_id, content, score). Entities in no paragraph, and those whose
    total is not above 0, are left out; ties go to the smaller content. Pairs are counted as they are met, per document."""
    hits = paragraphs.join(entities.select("doc_id", "content"), "doc_id").where(F.col("p").contains(F.col("content")))
    df = hits.groupBy("doc_id", "content").agg(F.count("*").alias("df"))
    s = entities.join(df, ["doc_id", "content"]).withColumn("total", F.col("score") * (1 + F.log(F.col("df") + 1.0))).where("total > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("total", 9)), "content")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("doc_id", "content", "df", "total", "rank")


def entity_headings(entities: DataFrame, documents: DataFrame, headings: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, content, heading_id, pos: the deepest heading around the first of an entity's first `most` occurrences that
    lies in any heading; entities outside all headings have no row."""
    from quillgraph.operators.matching import first_positions

    at = entities.select("doc_id", "content").distinct().join(documents.select("doc_id", F.col("raw_text").alias("t")).where("t is not null"), "doc_id")
    at = at.select("doc_id", "content", F.explode(first_positions(F.col("t"), F.col("content"), most)).alias("pos"))
    at = materialize(at, "entity-positions")
    inside = g.heading_at(at.select("doc_id", "pos").distinct(), headings).where("heading_id is not null")
    hit = at.join(inside, ["doc_id", "pos"])
    return hit.groupBy("doc_id", "content").agg(F.min(F.struct("pos", "heading_id")).alias("b")).select("doc_id", "content", "b.heading_id", "b.pos")


def section_links(headings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, a, b, shared, crossing, weight: pairs a < b of top headings of one document whose subtrees share entity
    contents or are crossed by edges that are no tree edges; weight min(1 + 0.5 * shared + 0.3 * crossing, 5)."""
    h = latest(headings.select("heading_id", "doc_id", "ingested_at"), "heading_id", "ingested_at").where("doc_id is not null").select("heading_id", "doc_id")
    root = hierarchy(heading_links(headings)).where("root_id <> '-'").select(F.col("item_id").alias("heading_id"), "root_id")
    h = h.join(root, "heading_id", "left").select("heading_id", "doc_id", F.coalesce("root_id", "heading_id").alias("top"))
    inner = nodes.where("node_type in ('entity', 'concept') and heading_id is not null and content is not null").select("node_id", "heading_id", "content")
    inner = materialize(inner.join(h, "heading_id").select("node_id", "doc_id", "top", "content"), "section-nodes")
    c = inner.select("doc_id", "top", "content").distinct()
    shared = c.withColumnRenamed("top", "a").join(c.withColumnRenamed("top", "b"), ["doc_id", "content"]).where("a < b").groupBy("doc_id", "a", "b").agg(F.count("*").alias("shared"))
    e = edges.where(~F.col("edge_type").isin("contains", "hierarchy", "includes", "belong", "idea-hierarchy"))
    f = inner.select(F.col("node_id").alias("from_id"), F.col("doc_id").alias("d1"), F.col("top").alias("ta"))
    t = inner.select(F.col("node_id").alias("to_id"), F.col("doc_id").alias("d2"), F.col("top").alias("tb"))
    x = e.select("from_id", "to_id").join(f, "from_id").join(t, "to_id").where("d1 = d2 and ta <> tb")
    x = x.groupBy(F.col("d1").alias("doc_id"), F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.count("*").alias("crossing"))
    out = shared.join(x, ["doc_id", "a", "b"], "full").na.fill(0, ["shared", "crossing"])
    return out.withColumn("weight", F.least(1 + 0.5 * F.col("shared") + 0.3 * F.col("crossing"), F.lit(5.0)))


def node_display(ranks: DataFrame) -> DataFrame:
    """node_id, size, is_hub: size 8 + 22 * rank / greatest rank, a hub above half of the greatest."""
    most = ranks.agg(F.max("rank").alias("most"))  # one row
    share = F.when(F.col("most") > 0, F.col("rank") / F.col("most")).otherwise(0.0)
    return ranks.join(F.broadcast(most)).select("node_id", (8 + 22 * share).alias("size"), (share > 0.5).alias("is_hub"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, avg_degree (2E / max(1, V), two places), n_types, isolated: one row."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("node_type").alias("n_types"))
    e = edges.agg(F.count("*").alias("n_edges"))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    lone = nodes.join(ends, "node_id", "left_anti").agg(F.count("*").alias("isolated"))
    return n.join(F.broadcast(e)).join(F.broadcast(lone)).select("n_nodes", "n_edges", F.round(2 * F.col("n_edges") / F.greatest("n_nodes", F.lit(1)), 2).alias("avg_degree"), "n_types", "isolated")


def link_keywords(c: Column) -> Column:
    """Distinct keys of a label: words of two or more of its link form, and pairs of ideographs."""
    n = link_form(c)
    words = F.filter(F.split(n, r"[^一-龥a-z0-9]+"), lambda w: F.length(w) >= 2)
    pairs = F.flatten(F.transform(F.regexp_extract_all(n, F.lit("([一-龥]{2,})"), 1), lambda r: tk.grams(r, 2)))
    return F.array_distinct(F.concat(words, pairs))


def document_keywords(nodes: DataFrame) -> DataFrame:
    """Distinct doc_id, keyword over headings and entities."""
    n = nodes.where("node_type in ('heading', 'entity') and doc_id is not null and content is not null")
    return n.select("doc_id", F.explode(link_keywords(F.col("content"))).alias("keyword")).distinct()


def document_relevance(nodes: DataFrame, sources: DataFrame, terms: list[str], least: float = 0.0) -> DataFrame:
    """doc_a, doc_b, jaccard, name_sim, relevance of source documents (doc_id) with all that share a keyword.

    min(1, 0.9 * Jaccard + 0.3 * similarity of names); with names alike by 0.6 or more at least 0.8. Pairs of two
    sources come once, the smaller first. Documents without a common keyword are not compared: their relevance is that of
    their names alone. With `least` above 0 only pairs of that relevance (to nine places) come, and all of them: they are
    found by keys of their keywords and names.
    """
    return _relevance(_linked_documents(nodes, sources, terms), terms, least)


def _linked_documents(nodes: DataFrame, sources: DataFrame, terms: list[str]) -> DataFrame:
    kw = document_keywords(nodes).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_list("keyword").alias("kw"))
    names = nodes.where("node_type = 'document' and doc_id is not null").groupBy("doc_id").agg(F.min("content").alias("name"))
    names = names.select("doc_id", "name", F.array_distinct(tk.dict_tokens(F.col("name"), terms)).alias("t"))
    docs = kw.join(names, "doc_id", "left").join(sources.select("doc_id", F.lit(True).alias("first")).distinct(), "doc_id", "left").na.fill(False, ["first"])
    return materialize(docs.withColumns({"name": F.coalesce("name", F.lit("")), "t": F.coalesce("t", F.array().cast("array<string>"))}), "link-keywords")


def _relevance(docs: DataFrame, terms: list[str], least: float) -> DataFrame:
    if least > 0:
        # names alike by less than 0.6 add less than 0.18
        by = [("kw", "members", max(SLACK, (least - 0.18) / 0.9 - SLACK)), *text_rules("name", "t", least if least > 0.8 else 0.6)]
        both = candidates(docs.withColumn("id", F.col("doc_id").cast("bigint")), by, "kw").withColumnsRenamed({"a": "doc_a", "b": "doc_b"})
    else:
        kw = docs.select("doc_id", "first", F.explode("kw").alias("keyword"))
        a = kw.where("first").select(F.col("doc_id").alias("x"), "keyword")
        both = a.join(kw.select(F.col("doc_id").alias("y"), "keyword"), "keyword").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("both"))
        both = both.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.first("both").alias("both"))
    cols = ["n", "name", "t", *(["kw"] if least > 0 else [])]
    side = lambda k: docs.select(F.col("doc_id").alias(f"doc_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in cols])
    p = both.join(side("a"), "doc_a").join(side("b"), "doc_b")
    if least > 0:
        p = p.withColumn("both", F.size(F.array_intersect("kw_a", "kw_b"))).where("both > 0")
    j = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    s = sim.text_similarity(F.col("name_a"), F.col("name_b"), terms, F.col("t_a"), F.col("t_b"))
    p = p.select("doc_a", "doc_b", j.alias("jaccard"), s.alias("name_sim"))
    p = p.withColumn("relevance", F.when(F.col("name_sim") >= 0.6, F.greatest(F.lit(0.8), F.col("name_sim"))).otherwise(F.least(F.lit(1.0), 0.9 * F.col("jaccard") + 0.3 * F.col("name_sim"))))
    return p.where(F.round("relevance", 9) >= least) if least > 0 else p


def cross_links(nodes: DataFrame, relevance: DataFrame, terms: list[str], threshold: float = 0.18, most: int = 600) -> DataFrame:
    """from_id, to_id, sim, relevance, order: candidate links between headings and entities of related documents.

    Candidates share a key of their labels; a document pair keeps its best floor(150 * relevance), 20 to 120 of them,
    and document pairs spend the total of `most` in the order of their relevance. Ties go to the smaller ids. Only the first
    document pairs are looked into, and more of them until the total is spent or none is left.
    """
    n = nodes.where("node_type in ('heading', 'entity') and doc_id is not null and content is not null").select("node_id", "doc_id", "content")
    rel = materialize(relevance.select("doc_a", "doc_b", "relevance"), "cross-relevance")
    have, some = rel.count(), most
    while True:
        part = rel if some >= have else materialize(rel.orderBy(F.desc(F.round("relevance", 9)), "doc_a", "doc_b").limit(some), "cross-first")
        out = materialize(_links_of(n, part, terms, threshold, most), "cross-links")
        if some >= have or out.count() >= most:
            return out
        some = some * 8 if some < 100_000 else have


def _links_of(n: DataFrame, rel: DataFrame, terms: list[str], threshold: float, most: int) -> DataFrame:
    n = n.join(rel.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("form", link_form(F.col("content")))
    keys = materialize(n.select("node_id", "doc_id", "form", F.explode(link_keywords(F.col("content"))).alias("key")), "cross-keys")
    a = rel.join(keys.select(F.col("doc_id").alias("doc_a"), F.col("node_id").alias("a"), F.col("form").alias("fa"), "key"), "doc_a")
    pairs = a.join(keys.select(F.col("doc_id").alias("doc_b"), F.col("node_id").alias("b"), F.col("form").alias("fb"), "key"), ["doc_b", "key"]).drop("key").distinct()
    # a form that comes again is compared once
    forms = materialize(pairs.select("fa", "fb").distinct().withColumn("sim", sim.label_similarity(F.col("fa"), F.col("fb"), terms)).where(F.col("sim") >= threshold), "cross-forms")
    pairs = pairs.join(forms, ["fa", "fb"])
    quota = F.greatest(F.lit(20), F.least(F.lit(120), F.floor(F.col("relevance") * 150)))
    w = Window.partitionBy("doc_a", "doc_b").orderBy(F.desc(F.round("sim", 9)), "a", "b")
    kept = materialize(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota), "cross-kept")
    # the best document pairs first, until the total is spent: no more than `most` pairs can take part
    docs = kept.groupBy("doc_a", "doc_b", "relevance").agg(F.count("*").alias("n")).orderBy(F.desc(F.round("relevance", 9)), "doc_a", "doc_b").limit(most)
    run = Window.orderBy(F.desc(F.round("relevance", 9)), "doc_a", "doc_b").rowsBetween(Window.unboundedPreceding, -1)  # over at most `most` rows
    docs = docs.withColumn("spent", F.coalesce(F.sum("n").over(run), F.lit(0))).where(F.col("spent") < most).select("doc_a", "doc_b", "spent")
    out = kept.join(F.broadcast(docs), ["doc_a", "doc_b"]).where(F.col("spent") + F.col("rank") <= most)
    return out.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "sim", "relevance", (F.col("spent") + F.col("rank")).cast("int").alias("order"))


def best_cross_links(nodes: DataFrame, sources: DataFrame, terms: list[str], threshold: float = 0.18, most: int = 600) -> DataFrame:
    """cross_links() of source documents (doc_id): those of the most relevant pairs spend the total first, so less relevant
    ones are looked for only while it isn't spent, at last all."""
    docs = _linked_documents(nodes, sources, terms)
    for least in (1.0, 0.95, 0.9, 0.0):
        out = cross_links(nodes, _relevance(docs, terms, least), terms, threshold, most)
        if not least or out.count() >= most:
            return out


def new_links(before: DataFrame, after: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose key was not there before and that are valid."""
    k = before.select(g.edge_key().alias("k"))
    return g.valid_edges(after.withColumn("k", g.edge_key()).join(k, "k", "left_anti").drop("k"), nodes)


def merge_concepts(nodes: DataFrame, edges: DataFrame, terms: list[str], aliases: DataFrame | None = None, threshold: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merged: node_id, into): concepts and entities that say the same become one.

    A node goes into the smallest node it may merge with that itself stays; equal contents, text similarity of
    `threshold` or a row of aliases (content, alias) make two mergeable, but never entities of different documents.
    Only contents sharing a token are compared, each pair once, and of these those that text_candidates() finds by a key. Aliases are united, the greatest weight is kept,
    edges move along and self-loops go. The choice of leaders is repeated until no open node is left: in each round the
    nodes that have no smaller open neighbour lead, and take in those around them.
    """
    n = materialize(nodes, "merge-nodes")
    c = n.where("node_type in ('concept', 'entity') and content is not null").select("node_id", "node_type", "doc_id", "content")
    place = F.when(F.col("node_type") == "entity", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # entities of one document and content are one group; concepts of one content too: representatives carry the comparison
    grp = c.withColumn("place", place).groupBy("content", "place").agg(F.min("node_id").alias("rep"))
    grp = materialize(grp.orderBy("rep").withColumn("g", F.monotonically_increasing_id()), "merge-groups")  # numbers in the order of the ids
    free = lambda p: F.coalesce(F.col(p), F.lit("")) == ""
    texts = grp.groupBy("content").agg(F.max(free("place")).alias("first")).withColumn("t", F.array_distinct(tk.dict_tokens(F.col("content"), terms)))
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "merge-texts")
    # two groups may merge if they have one place or either has none: only contents with such groups are compared
    tok = grp.where(~free("place")).join(texts.select("content", "id", F.explode("t").alias("token")), "content").select("place", "token", "id", F.col("content").alias("x"), F.col("g").alias("a"))
    inner = tok.join(tok.select("place", "token", F.col("id").alias("id2"), F.col("x").alias("y"), F.col("a").alias("b")), ["place", "token"]).where("id < id2").select("id", "id2", "x", "y", "a", "b").distinct()
    inner = materialize(inner, "merge-inner")
    pairs = text_candidates(texts, threshold).unionByName(inner.select(F.col("id").alias("a"), F.col("id2").alias("b"))).distinct()
    near = materialize(alike_texts(pairs, texts, threshold), "merge-near")
    x = grp.select("content", F.col("place").alias("pa"), F.col("g").alias("a"))
    y = grp.select(F.col("content").alias("other"), F.col("place").alias("pb"), F.col("g").alias("b"))
    inside = inner.select(F.least("x", "y").alias("content"), F.greatest("x", "y").alias("other"), "a", "b").join(near, ["content", "other"])
    links = [inside, x.where(free("pa")).join(y.withColumnRenamed("other", "content"), "content")]
    if aliases is not None:
        said = aliases.select("content", F.col("alias").alias("other")).where("content is not null and other is not null and content <> other").distinct()
        links.append(x.join(said, "content").join(y.withColumnRenamed("pb", "pa"), ["other", "pa"]))
        near = near.unionByName(said)
    both = near.unionByName(near.select(F.col("other").alias("content"), F.col("content").alias("other"))).distinct()
    links.append(x.where(free("pa")).join(both, "content").join(y, "other"))
    pair = F.when(F.col("a") > F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = reduce(DataFrame.unionByName, [k.where("a <> b").select(pair.alias("p")).select("p.*") for k in links])
    live = materialize(links, "merge-links")  # b < a; some come twice, which changes nothing
    into = None
    while not live.isEmpty():
        lead = live.join(live.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        took = materialize(lead.groupBy("a").agg(F.min("b").alias("into")).select(F.col("a").alias("node_id"), "into"), "merge-took")
        into = took if into is None else into.unionByName(took)
        gone = took.select("node_id")
        live = materialize(live.join(gone.withColumnRenamed("node_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("node_id", "b"), "b", "left_anti"), "merge-live")
    if into is not None:  # numbers back to ids
        ids = grp.select(F.col("g").alias("node_id"), "rep"), grp.select(F.col("g").alias("into"), F.col("rep").alias("leader"))
        into = materialize(into.join(ids[0], "node_id").join(ids[1], "into").select(F.col("rep").alias("node_id"), F.col("leader").alias("into")), "merge-into")
    of = grp.select(F.col("content").alias("gc"), F.col("place").alias("gp"), "rep")
    reps = c.withColumn("place", place).join(of, (F.col("content") == F.col("gc")) & F.col("place").eqNullSafe(F.col("gp"))).select("node_id", "rep")
    if into is not None:
        reps = reps.join(into.select(F.col("node_id").alias("rep"), "into"), "rep", "left").select("node_id", F.coalesce("into", "rep").alias("into"))
    else:
        reps = reps.withColumnRenamed("rep", "into")
    merged = materialize(reps.where("node_id <> into"), "merge-map")
    gone = n.join(merged, "node_id").groupBy("into").agg(F.max("weight").alias("w"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("content"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("al"))
    left = n.join(merged.select("node_id"), "node_id", "left_anti").join(gone.withColumnRenamed("into", "node_id"), "node_id", "left")
    united = F.array_except(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "al"), F.array("content"))
    left = left.withColumns({"weight": F.greatest("weight", "w"), "aliases": F.when(F.col("al").isNull(), F.col("aliases")).otherwise(united)}).drop("w", "al")
    f, t = merged.select(F.col("node_id").alias("from_id"), F.col("into").alias("f2")), merged.select(F.col("node_id").alias("to_id"), F.col("into").alias("t2"))
    moved = edges.join(f, "from_id", "left").join(t, "to_id", "left").withColumns({"from_id": F.coalesce("f2", "from_id"), "to_id": F.coalesce("t2", "to_id")}).drop("f2", "t2")
    return left, g.upsert_edges(moved.where("from_id <> to_id")), merged


def graph_score(adj: DataFrame, ranks: DataFrame, seed: str) -> DataFrame:
    """node_id, common, score of every node against a seed: half the share of common neighbours plus ten times its
    personalised rank, at most a half; the seed itself scores 1. Neighbour lists count parallel edges."""
    one = adj.where(F.col("src") == seed).select(F.col("dst").alias("x")).distinct()
    n1 = adj.where(F.col("src") == seed).agg(F.count("*").alias("n1"))
    common = adj.join(one, F.col("dst") == F.col("x")).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("common"))
    n2 = adj.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n2"))
    out = ranks.join(n2, "node_id", "left").join(common, "node_id", "left").na.fill(0, ["n2", "common"]).join(F.broadcast(n1))
    all_ = F.col("n1") + F.col("n2") - F.col("common")
    score = 0.5 * F.when(all_ > 0, F.col("common") / all_).otherwise(0.0) + F.least(10 * F.col("rank"), F.lit(0.5))
    return out.select("node_id", "common", F.when(F.col("node_id") == seed, 1.0).otherwise(score).alias("score"))


def neighbourhood(edges: DataFrame, of: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node_id, neighbour: the ends of visible edges in either direction."""
    e = edges if kinds is None else edges.where(F.col("edge_type").isin(kinds))
    both = e.select(F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.col("to_id").alias("neighbour")), F.struct(F.col("to_id").alias("node_id"), F.col("from_id").alias("neighbour")))).alias("s")).select("s.*")
    return both.join(of.select("node_id").distinct(), "node_id", "left_semi").distinct()


def node_groups(nodes: DataFrame, label: str = "") -> DataFrame:
    """ord, node_type, n, first: nodes whose content holds the label, by type in canonical order."""
    n = nodes.where(F.lower("content").contains(label.strip().lower())) if label.strip() else nodes
    at = F.coalesce(*[F.when(F.col("node_type") == t, F.lit(k)) for k, t in enumerate(TYPE_ORDER)], F.lit(len(TYPE_ORDER)))
    return n.groupBy("node_type").agg(F.count("*").alias("n"), F.min("content").alias("first")).select(at.alias("ord"), "node_type", "n", "first")


def structural_graph(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """from_id, to_id, edge_type: document to chapter (level 1) to section (level 2, of the chapter before it); sections
    before any chapter hang on their document."""
    h = latest(headings.select("heading_id", "doc_id", "ord", "heading_level", "ingested_at"), "heading_id", "ingested_at").where("heading_level in (1, 2) and ord is not null")
    h = h.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    w = Window.partitionBy("doc_id").orderBy("ord", "heading_id").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("heading_level") == 1, F.col("heading_id")), ignorenulls=True).over(w)
    doc = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    h = h.withColumn("above", above)
    return h.select(F.when(F.col("heading_level") == 1, doc).otherwise(F.coalesce("above", doc)).alias("from_id"), F.col("heading_id").alias("to_id"), F.lit("contains").alias("edge_type"))


def visible_tree(parents: DataFrame, opened: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible node_ids, visible edges): roots, and children of opened nodes (node_id) all of whose ancestors are open.

    parents has (item_id, path) from the root down, as hierarchy() gives them with paths; nodes without a path are roots.
    """
    open_ids = opened.select(F.col("node_id").alias("anc"), F.lit(1).alias("open")).distinct()
    above = parents.where("path is not null").select("item_id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("anc"))
    shut = above.join(open_ids, "anc", "left").where("open is null").select("item_id").distinct()
    inner = parents.where("path is not null").select("item_id").join(shut, "item_id", "left_anti").select(F.col("item_id").alias("node_id"))
    roots = parents.where("path is not null").select(F.element_at("path", 1).alias("node_id"))
    seen = inner.unionByName(roots).distinct()
    e = edges.join(seen.select(F.col("node_id").alias("from_id")), "from_id", "left_semi").join(seen.select(F.col("node_id").alias("to_id")), "to_id", "left_semi")
    return seen, e


def document_graph(documents: DataFrame, headings: DataFrame, terms: list[str], stop_words: list[str], top: int = 80) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc_id, doc_name, text, raw_text) from their words alone.

    nodes: node_id, doc_id, node_type, content, weight. A document node each; a node for every counted heading; the
    `top` keywords of a document that stand in its paragraphs and are no rubbish, as entities.
    edges: from_id, to_id, edge_type, weight. Headings hang on their parent or the document (`hierarchy`), entities on the
    heading around their first occurrence or the document (`contains`), relation patterns whose two ends are entities of
    the document, and entities that share sentences (`co-occurrence`, at most 5). An edge that comes several times
    keeps its greatest weight. Documents without text give their node alone; null doc_ids are left out.
    """
    d = documents.where("doc_id is not null").select("doc_id", "doc_name", "text", "raw_text")
    body = d.withColumn("text", F.coalesce(F.when(F.col("text") != "", F.col("text")), "raw_text")).where("text <> ''")
    h = latest(headings.select("heading_id", "doc_id", "title", "heading_level", "start_pos", "end_pos", "ingested_at"), "heading_id", "ingested_at")
    h = materialize(h.join(d.select("doc_id").distinct(), "doc_id", "left_semi"), "graph-headings")
    read = _read_documents(body, h, terms, stop_words, top)
    name = lambda kind, *c: F.concat_ws("_", F.lit(kind), *[x if isinstance(x, Column) else F.col(x) for x in c])
    ents = read.select("doc_id", F.explode(F.arrays_zip("ids", "names", "totals", "held")).alias("e")).select("doc_id", "e.*")
    entity_nodes = ents.select(F.col("ids").alias("node_id"), "doc_id", F.lit("entity").alias("node_type"), F.col("names").alias("content"), F.col("totals").alias("weight"))
    heading_nodes = h.select(F.col("heading_id").alias("node_id"), "doc_id", F.lit("heading").alias("node_type"), F.col("title").alias("content"), (5 - F.coalesce("heading_level", F.lit(3))).cast("double").alias("weight"))
    doc_nodes = d.groupBy("doc_id").agg(F.min("doc_name").alias("content")).select(name("doc", "doc_id").alias("node_id"), "doc_id", F.lit("document").alias("node_type"), "content", F.lit(1.0).alias("weight"))
    nodes = doc_nodes.unionByName(heading_nodes).unionByName(entity_nodes)

    parents = heading_links(headings).groupBy("child").agg(F.min("parent").alias("parent"))
    tree = h.join(parents, F.col("heading_id") == F.col("child"), "left").select(F.coalesce("parent", name("doc", "doc_id")).alias("from_id"), F.col("heading_id").alias("to_id"), F.lit("hierarchy").alias("edge_type"), F.lit(HIERARCHY_WEIGHT).alias("weight"))
    held = ents.select(F.coalesce("held", name("doc", "doc_id")).alias("from_id"), F.col("ids").alias("to_id"), F.lit("contains").alias("edge_type"), F.lit(CONTAINS_WEIGHT).alias("weight"))
    rel = read.select("ids", F.explode(F.arrays_zip("rel_a", "rel_b", "rel_kind", "rel_weight")).alias("r"))
    rel = rel.select(F.get("ids", F.col("r.rel_a")).alias("from_id"), F.get("ids", F.col("r.rel_b")).alias("to_id"), F.col("r.rel_kind").alias("edge_type"), F.col("r.rel_weight").alias("weight"))
    both = read.select("ids", F.explode(F.arrays_zip("co_a", "co_b", "co_n")).alias("c"))
    a, b = F.get("ids", F.col("c.co_a")), F.get("ids", F.col("c.co_b"))
    both = both.select(F.least(a, b).alias("from_id"), F.greatest(a, b).alias("to_id"), F.lit("co-occurrence").alias("edge_type"), F.least("c.co_n", F.lit(5)).cast("double").alias("weight"))
    return nodes, tree.unionByName(held).unionByName(rel).unionByName(both)  # no edge comes from two of them, and none twice from one


def _read_documents(body: DataFrame, headings: DataFrame, terms: list[str], stop_words: list[str], top: int) -> DataFrame:
    """document_pass.READ of every document: only counts of its words travel to their frequencies, and they, its headings and its
    text then to the document. A document may have several rows."""
    from quillgraph.functions.text import is_garbage_entity
    from quillgraph.operators import terms as tm

    known, t = set(terms), F.col("token")
    counts = body.select("doc_id", tk.dict_matches(F.col("text"), terms).alias("found")).mapInArrow(partial(dp.counted, terms=known), dp.COUNTS)
    n, most = body.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (most or 0) > 1:
        counts = counts.groupBy("doc_id", "token").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))
    counts = materialize(counts, "graph-counts")
    is_term = body.sparkSession.createDataFrame([(x,) for x in terms], "token string").withColumn("is_term", F.lit(True))  # bounded by dictionary()
    # what depends on the word alone is found once for each word
    words = tm.idf(counts, max(1, n or 0)).join(F.broadcast(is_term), "token", "left").na.fill(False, ["is_term"]).where(F.col("is_term") | tm.plain_token(t, stop_words))
    factor = F.when(F.coalesce("idf", F.lit(0.0)) == 0, 1.0).otherwise(F.col("idf"))
    words = materialize(words.select("token", F.when(F.col("is_term"), 3.0).otherwise(1.0).alias("times"), factor.alias("factor"), is_garbage_entity(t, stop_words).cast("int").alias("lv")), "graph-words")
    score = F.col("tf") * F.col("times") * F.col("factor")
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    w = counts.join(words, "token").select("doc_id", F.lit(0).alias("kind"), t.alias("s"), score.alias("x"), F.col("first_pos").cast("bigint").alias("i"), *null("bigint", "j"), "lv", *null("string", "text", "raw"))
    h = headings.where("end_pos > start_pos").select("doc_id", F.lit(1).alias("kind"), F.col("heading_id").alias("s"), *null("double", "x"), F.col("start_pos").cast("bigint").alias("i"), F.col("end_pos").cast("bigint").alias("j"), F.col("heading_level").cast("int").alias("lv"), *null("string", "text", "raw"))
    x = body.select("doc_id", F.lit(2).alias("kind"), *null("string", "s"), *null("double", "x"), *null("bigint", "i", "j"), *null("int", "lv"), "text", F.col("raw_text").alias("raw"))
    rows = w.unionByName(h).unionByName(x).repartition("doc_id").sortWithinPartitions("doc_id", "kind")
    low = F.lower("text")
    rows = rows.select("doc_id", "kind", "s", "x", "i", "j", "lv", low.alias("low"), F.lower("raw").alias("raw"), tk.sentence_matches(low, terms).alias("found"))
    return materialize(rows.mapInArrow(partial(dp.read, terms=known, candidates=top * 2, top=top, occurrences=10, of_unit=10), dp.READ), "graph-read")
