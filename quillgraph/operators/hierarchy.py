"""Parent-child links of unknown depth to roots, depths, paths and descendants, with cycles told.

Links are range-partitioned by child, so that neighbours in id order meet. In each partition a weighted
disjoint-set forest takes the links: every item points to the furthest ancestor it can reach there, with
the number of links to it. Ancestors that are themselves children elsewhere form the next, smaller set of
links, merged in fewer partitions, until one level holds no such ancestor. Results then flow back down,
level by level. If a level stops shrinking while still large, its links are squared by joins instead, so
no task ever takes an unbounded set.

An item with several parents starts a tree of its own at first; a last step resolves these items from the
top down. What that step cannot resolve lies on or below a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.shared import latest, materialize

#: Links one task takes.
PER_TASK = 200_000


class WeightedForest:
    """Disjoint sets in which every element knows the number of links to its set's top."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.dist = [0] * n
        self.loop = [False] * n

    def find(self, x: int) -> int:
        """Top of x; afterwards up[x] is the top and dist[x] the links to it."""
        up, dist = self.up, self.dist
        trail = []
        while up[x] != x:
            trail.append(x)
            x = up[x]
        total = 0
        for y in reversed(trail):
            total += dist[y]
            dist[y], up[y] = total, x
        return x

    def link(self, child: int, parent: int, weight: int) -> None:
        """Hang the set of which child is the top below parent."""
        top = self.find(parent)
        if top == child:
            self.loop[child] = True  # parent lies below child: the link closes a cycle
            return
        self.up[child] = parent
        self.dist[child] = weight


def _local(with_paths: bool):
    """mapInPandas step: (item, anc, dist, cyc[, path]) links of one partition, joined as far as they go."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        if pdf.empty:
            return
        n = len(pdf)
        codes, values = pd.factorize(pd.concat([pdf["item"], pdf["anc"]], ignore_index=True))
        child, parent = codes[:n], codes[n:]
        f = WeightedForest(len(values))
        weights, dead = pdf["dist"].tolist(), pdf["cyc"].tolist()
        for c, p, w, cyc in zip(child.tolist(), parent.tolist(), weights, dead):
            if cyc:
                f.loop[c] = True
            else:
                f.link(c, p, w)
        tops = [f.find(c) for c in child.tolist()]
        cyc = np.array([f.loop[t] for t in tops])
        out = pd.DataFrame({"item": pdf["item"], "anc": np.asarray(values, dtype=object)[tops], "dist": np.array([f.dist[c] for c in child.tolist()], dtype=np.int64), "cyc": cyc})
        if with_paths:
            # indexed parent traversal: a segment runs from the parent up to the top reached here
            row = {c: k for k, c in enumerate(child.tolist())}
            given, done = pdf["path"].tolist(), {}
            for k, c in enumerate(child.tolist()):
                trail, x = [], c
                while x in row and x not in done and not cyc[k]:
                    trail.append(x)
                    x = int(parent[row[x]])
                for y in reversed(trail):
                    q = int(parent[row[y]])
                    done[y] = list(given[row[y]]) + done.get(q, [])
            out["path"] = [[] if z else done[c] for c, z in zip(child.tolist(), cyc)]
        yield out

    return step


def _square(links: DataFrame, with_paths: bool) -> DataFrame:
    """Resolve links by doubling: each round joins every open item with its ancestor's own row."""
    done, open_, before = None, materialize(links, "hier-square"), -1
    while True:
        keys = open_.select(F.col("item").alias("k"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("cyc").alias("cyc2"), *([F.col("path").alias("path2")] if with_paths else []))
        j = open_.join(keys, F.col("anc") == F.col("k"), "left")
        path = [F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path")] if with_paths else []
        nxt = j.select("item", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("cyc") | F.coalesce("cyc2", F.lit(False))).alias("cyc"), *path, F.col("k").isNotNull().alias("moved"))
        nxt = materialize(nxt, "hier-square")
        left = nxt.where("moved and not cyc").count()
        open_ = nxt.drop("moved")
        if left in (0, before):  # no fewer open items than a round ago: those left never reach a root
            return open_ if left == 0 else nxt.withColumn("cyc", F.col("cyc") | F.col("moved")).drop("moved")
        before = left


def resolve_forest(links: DataFrame, with_paths: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """item, anc (its root), dist (links to it), cyc[, path from parent to root] for links (child, parent), one per child.

    An item that is its own parent, on a cycle or below one has cyc true and no meaningful anc and dist.
    """
    path = [F.array("parent").alias("path")] if with_paths else []
    level = links.select(F.col("child").alias("item"), F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("dist"), (F.col("child") == F.col("parent")).alias("cyc"), *path)
    schema = "item string, anc string, dist bigint, cyc boolean" + (", path array<string>" if with_paths else "")
    level = materialize(level, "hier-links")
    count, levels, top = level.count(), [], None
    while count:
        parts = max(1, -(-count // per_task))
        ranged = level.coalesce(1) if parts == 1 else level.repartitionByRange(parts, "item")
        local = materialize(ranged.mapInPandas(_local(with_paths), schema), "hier-level")
        if parts == 1:
            top = local
            break
        levels.append(local)
        tops = local.where("not cyc").select(F.col("anc").alias("k")).distinct()
        level = materialize(local.join(tops, F.col("item") == F.col("k"), "left_semi"), "hier-links")
        before, count = count, level.count()
        if count > per_task and count > 0.7 * before:
            top = _square(level, with_paths)
            break
    for local in reversed(levels):
        if top is None:
            top = local
            continue
        up = top.select(F.col("item").alias("k"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("cyc").alias("cyc2"), *([F.col("path").alias("path2")] if with_paths else []))
        j = local.join(up, (F.col("anc") == F.col("k")) & ~F.col("cyc"), "left")
        more = [F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path")] if with_paths else []
        top = j.select("item", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("cyc") | F.coalesce("cyc2", F.lit(False))).alias("cyc"), *more)
    return level if top is None else top


def hierarchy(links: DataFrame, with_paths: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """item_id, root_id, link_depth[, path] for every child of links (child, parent), any number of parents each.

    root_id is the topmost ancestor and link_depth the number of links to it; with several ways up, the
    longest counts, then the smallest root_id, then the smallest parent. path runs from the root to the
    item. An item on a cycle or below one on any way up has root_id `-`, link_depth -1 and a null path.
    Null ends are ignored, repeated links count once; other columns are ignored; no links, no rows.
    """
    links = materialize(links.where("child is not null and parent is not null").select(F.col("child").cast("string"), F.col("parent").cast("string")).distinct(), "hier-input")
    many = links.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select("child")
    many = materialize(many, "hier-many")
    if many.isEmpty():
        res = resolve_forest(links, with_paths, per_task)
    else:
        single = resolve_forest(links.join(many, "child", "left_anti"), with_paths, per_task)
        res = _with_many(links.join(many, "child", "left_semi"), many, single, with_paths)
    path = [F.when(~F.col("cyc"), F.concat(F.reverse("path"), F.array("item"))).alias("path")] if with_paths else []
    return res.select(F.col("item").alias("item_id"), F.when(F.col("cyc"), "-").otherwise(F.col("anc")).alias("root_id"), F.when(F.col("cyc"), F.lit(-1)).otherwise(F.col("dist")).cast("bigint").alias("link_depth"), *path)


def _with_many(links: DataFrame, many: DataFrame, single: DataFrame, with_paths: bool) -> DataFrame:
    """Resolve items with several parents from the top down, then what hangs below them."""
    single = materialize(single, "hier-single")
    p = [F.col("path")] if with_paths else []
    own = F.array("parent")
    s = single.select(F.col("item").alias("k"), "anc", "dist", "cyc", *p)
    path = [F.when(F.col("k").isNull(), own).otherwise(F.concat(own, "path")).alias("path")] if with_paths else []
    ways = links.join(s, F.col("parent") == F.col("k"), "left").select(F.col("child").alias("item"), "parent", F.coalesce("anc", "parent").alias("anc"), (F.lit(1) + F.coalesce("dist", F.lit(0))).alias("dist"), F.coalesce("cyc", F.lit(False)).alias("cyc"), *path)
    m = many.select(F.col("child").alias("m"))
    ways = materialize(ways.join(m, F.col("anc") == F.col("m"), "left").withColumn("open", F.col("m").isNotNull()).drop("m"), "hier-ways")
    done = None
    while True:
        # an item is ready when no way up is cyclic or open; its longest way is taken
        best = F.min(F.struct((-F.col("dist")).alias("nd"), "anc", "parent", *p)).alias("b")
        ready = ways.groupBy("item").agg(F.max(F.col("open") | F.col("cyc")).alias("wait"), best).where("not wait").select("item", "b.anc", (-F.col("b.nd")).alias("dist"), *([F.col("b.path").alias("path")] if with_paths else []))
        ready = materialize(ready, "hier-ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        r = ready.select(F.col("item").alias("k"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), *([F.col("path").alias("path2")] if with_paths else []))
        rest = ways.join(ready.select("item"), "item", "left_anti").join(r, F.col("anc") == F.col("k"), "left")
        more = [F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path")] if with_paths else []
        ways = materialize(rest.select("item", "parent", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), "cyc", *more, (F.col("open") & F.col("k").isNull()).alias("open")), "hier-ways")
        if ways.isEmpty():
            break
    stuck = ways.select("item").distinct().select("item", F.col("item").alias("anc"), F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("cyc"), *([F.array().cast("array<string>").alias("path")] if with_paths else []))
    multi = stuck if done is None else stuck.unionByName(done.withColumn("cyc", F.lit(False)))
    multi = materialize(multi, "hier-multi")
    u = multi.select(F.col("item").alias("k"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("cyc").alias("cyc2"), *([F.col("path").alias("path2")] if with_paths else []))
    j = single.join(u, F.col("anc") == F.col("k"), "left")
    more = [F.when(F.col("k").isNull(), F.col("path")).otherwise(F.concat("path", "path2")).alias("path")] if with_paths else []
    below = j.select("item", F.coalesce("anc2", "anc").alias("anc"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), (F.col("cyc") | F.coalesce("cyc2", F.lit(False))).alias("cyc"), *more)
    return below.unionByName(multi)


def descendants(paths: DataFrame) -> DataFrame:
    """ancestor_id, item_id, distance (>= 1) of every acyclic item and each item above it on its path."""
    return paths.where("path is not null").select("item_id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor_id")).where("pos < n - 1").select("ancestor_id", "item_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))


def heading_links(headings: DataFrame) -> DataFrame:
    """child, parent of headings.

    The latest row of a heading_id counts. Parents come from children; in a document whose counted
    headings all have null children, the parent is the nearest heading before (by ord, then start_pos,
    then heading_id) with a smaller level; null levels and ords take no part there. Children that are no
    counted heading are ignored, repeated ones count once.
    """
    h = latest(headings.select("heading_id", "doc_id", "ord", "heading_level", "start_pos", "children", "ingested_at"), "heading_id", "ingested_at")
    h = materialize(h, "hier-headings")
    listed = h.select(F.col("heading_id").alias("parent"), F.explode("children").alias("child")).distinct()
    listed = listed.join(h.select(F.col("heading_id").alias("child")), "child", "left_semi")
    flat = h.groupBy("doc_id").agg(F.max(F.col("children").isNotNull()).alias("nested")).where("not nested").select("doc_id")
    f = h.where("doc_id is not null and ord is not null and heading_level is not null").join(flat, "doc_id", "left_semi")
    f = f.select("doc_id", "ord", "start_pos", "heading_id", F.col("heading_level").alias("level")).repartition("doc_id").sortWithinPartitions("doc_id", "ord", "start_pos", "heading_id")
    return listed.select("child", "parent").unionByName(f.mapInPandas(_stack, "child string, parent string"))


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parents of sorted headings: a stack of those still open, carried from batch to batch, no deeper than there are levels."""
    doc, stack = None, []
    for pdf in batches:
        out = []
        for d, key, level in zip(pdf["doc_id"], pdf["heading_id"], pdf["level"]):
            if d != doc:
                doc, stack = d, []
            while stack and stack[-1][0] >= level:
                stack.pop()
            if stack:
                out.append((key, stack[-1][1]))
            stack.append((level, key))
        yield pd.DataFrame(out, columns=["child", "parent"])


DOWNWARD = ("contains", "hierarchy", "includes", "idea-hierarchy")
UPWARD = ("belong",)


def node_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent of graph nodes from the parent-child edge types; both ends must have a row; repeated edges count once."""
    e = edges.where(F.col("edge_type").isin(*DOWNWARD, *UPWARD) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    up = F.col("edge_type").isin(*UPWARD)
    e = e.select(F.when(up, F.col("from_id")).otherwise(F.col("to_id")).alias("child"), F.when(up, F.col("to_id")).otherwise(F.col("from_id")).alias("parent")).distinct()
    ids = nodes.where("node_id is not null").select("node_id").distinct()
    e = e.join(ids, e.child == ids.node_id, "left_semi")
    return e.join(ids, e.parent == ids.node_id, "left_semi")


def document_trees(headings: DataFrame, nodes: DataFrame, edges: DataFrame, with_paths: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """hierarchy() of headings and of nodes together; the two kinds of id never mix."""
    tag = lambda df, k: df.select(F.concat(F.lit(k), "child").alias("child"), F.concat(F.lit(k), "parent").alias("parent"))
    both = tag(heading_links(headings), "h").unionByName(tag(node_links(nodes, edges), "n"))
    res = hierarchy(both, with_paths, per_task)
    bare = lambda c: F.substring(c, 2, 2**31 - 1)
    path = [F.transform("path", bare).alias("path")] if with_paths else []
    return res.select(bare(F.col("item_id")).alias("item_id"), F.when(F.col("root_id") == "-", "-").otherwise(bare(F.col("root_id"))).alias("root_id"), "link_depth", *path)
