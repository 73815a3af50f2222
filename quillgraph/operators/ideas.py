"""Ideas: checks, trees, links and their place in the graph; names of projects; the registry of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import hierarchy
from quillgraph.plans.shared import materialize

# Limits of idea fields and project names.
TITLE_MAX, CONTENT_MAX, PROJECT_MAX = 200, 100_000, 50
PROJECT_FORBIDDEN = r'[<>:"/\\|?*]'


def idea_problem(title: Column, content: Column) -> Column:
    """What keeps an idea from being stored: `title` if blank or too long, `content` if too long, else null."""
    blank = F.coalesce(F.trim(title), F.lit("")) == ""
    return F.when(blank | (F.length(title) > TITLE_MAX), "title").when(F.length(content) > CONTENT_MAX, "content")


def split_tags(c: Column) -> Column:
    """Distinct tags of a comma list, trimmed, blank ones dropped; null gives none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), F.trim), lambda t: t != ""))


def makes_cycle(links: DataFrame, moves: DataFrame) -> DataFrame:
    """child, parent, cycle: whether hanging child under parent would close a ring; links (child, parent) are as they are."""
    up = hierarchy(links, with_paths=True).select(F.col("item_id").alias("parent"), "path")
    m = moves.join(up, "parent", "left")
    return m.select("child", "parent", ((F.col("child") == F.col("parent")) | F.coalesce(F.array_contains("path", F.col("child")), F.lit(False))).alias("cycle"))


def subtree(links: DataFrame, roots: DataFrame) -> DataFrame:
    """node_id of the given nodes and all below them."""
    r = roots.select("node_id").distinct()
    below = hierarchy(links, with_paths=True).where("path is not null").select("item_id", F.explode("path").alias("node_id"))
    return r.unionByName(below.join(r, "node_id", "left_semi").select(F.col("item_id").alias("node_id"))).distinct()


def link_nodes(ideas: DataFrame, changes: DataFrame) -> DataFrame:
    """ideas (idea_id, related) after changes (idea_id, node_id, op: link or unlink); linking twice changes nothing, and a
    node both linked and unlinked is unlinked. Ideas that do not exist are ignored."""
    none = F.array().cast("array<string>")
    c = changes.groupBy("idea_id").agg(F.collect_set(F.when(F.col("op") == "link", F.col("node_id"))).alias("plus"), F.collect_set(F.when(F.col("op") == "unlink", F.col("node_id"))).alias("minus"))
    j = ideas.join(c, "idea_id", "left")
    return j.withColumn("related", F.array_sort(F.array_except(F.array_union(F.coalesce("related", none), F.coalesce("plus", none)), F.coalesce("minus", none)))).drop("plus", "minus")


def idea_edges(ideas: DataFrame, links: DataFrame, edges: DataFrame, linked: DataFrame) -> DataFrame:
    """from_id, to_id, edge_type after ideas were brought into the graph again: other edges stay, those of ideas are
    made anew, `idea-hierarchy` from parent to child, `belong` to the document (idea_id, doc_id), `idea-link` to related
    nodes (idea_id, node_id); ends that are no idea are left out of the first."""
    ids = ideas.select("idea_id").distinct()
    kept = edges.where(~F.col("edge_type").isin("idea-hierarchy", "idea-link")).select("from_id", "to_id", "edge_type")
    kept = kept.join(ids, (F.col("from_id") == F.col("idea_id")) & (F.col("edge_type") == "belong"), "left_anti")
    tree = links.join(ids.select(F.col("idea_id").alias("child")), "child", "left_semi").join(ids.select(F.col("idea_id").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("from_id"), F.col("child").alias("to_id"), F.lit("idea-hierarchy").alias("edge_type"))
    belong = ideas.where("doc_node is not null").select(F.col("idea_id").alias("from_id"), F.col("doc_node").alias("to_id"), F.lit("belong").alias("edge_type"))
    rel = linked.join(ids, "idea_id", "left_semi").select(F.col("idea_id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("idea-link").alias("edge_type"))
    return kept.unionByName(tree).unionByName(belong).unionByName(rel).distinct()


def recommend(scores: DataFrame, nodes: DataFrame, linked: DataFrame, top: int = 5) -> DataFrame:
    """query_id, node_id, score, rank: nodes of the documents that match an idea best (query_id, doc_id, score), not linked
    to it already (query_id, node_id); ties to the smaller node_id."""
    c = scores.join(nodes.where("node_type in ('heading', 'concept', 'entity')").select("doc_id", "node_id", "weight"), "doc_id")
    c = c.join(linked.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc_nulls_last("weight"), "node_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "node_id", "score", "rank")


def project_name_problem(name: Column) -> Column:
    """`blank`, `long` or `sign` if a name may not be used, else null."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return F.when(t == "", "blank").when(F.length(t) > PROJECT_MAX, "long").when(t.rlike(PROJECT_FORBIDDEN), "sign")


def free_names(names: DataFrame, taken: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """key, name, free: names that are taken, or come again, get ` (2)`, ` (3)` and so on in the order of key.

    taken has the column `name`. A numbered name that is itself taken pushes the number on by as many as are taken.
    """
    have = taken.select(F.col(name).alias("t")).distinct()
    base = names.withColumn("nth", F.row_number().over(Window.partitionBy(name).orderBy(key)))
    used = have.select(F.regexp_replace("t", r" \((\d+)\)$", "").alias(name), F.coalesce(F.expr(r"try_cast(regexp_extract(t, ' \\((\\d+)\\)$', 1) as int)"), F.lit(1)).alias("n")).groupBy(name).agg(F.max("n").alias("top"))
    j = base.join(used, name, "left").withColumn("k", F.col("nth") + F.coalesce("top", F.lit(0)))
    return j.select(key, name, F.when(F.col("k") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("free"))


def effective_prompts(defaults: DataFrame, overrides: DataFrame, search: str = "") -> DataFrame:
    """task, template, custom, enabled: every task with its override where it has one (task, template, enabled); blank
    overrides fall back, a null enabled means yes; search keeps tasks whose id, name or description hold it."""
    o = overrides.groupBy("task").agg(F.last("template").alias("own"), F.last("enabled").alias("on"))
    d = defaults.join(o, "task", "left")
    if search.strip():
        q = search.strip().lower()
        d = d.where(F.lower("task").contains(q) | F.lower("name").contains(q) | F.lower("description").contains(q))
    own = F.coalesce(F.trim("own"), F.lit("")) != ""
    return d.select("task", F.when(own, F.col("own")).otherwise(F.col("template")).alias("template"), own.alias("custom"), F.coalesce("on", F.lit(True)).alias("enabled"))
