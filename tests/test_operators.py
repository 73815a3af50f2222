from datetime import datetime as dt
from datetime import timedelta

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillgraph.operators import graph as g
from quillgraph.operators import matching as mt
from quillgraph.operators import terms as tm
from quillgraph.plans import catalog, q_graph
from quillgraph.sources import documents as src
from quillgraph.streaming import rate_limit as rl

EDGE = "from_id string, to_id string, edge_type string, weight double, link_method string, ingested_at timestamp_ntz"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, w, None, dt(2024, 1, 1 + n)) for n, (a, b, k, w) in enumerate(rows)], EDGE)


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_upsert_keeps_first_orientation(spark):
    got = [tuple(r)[:4] for r in g.upsert_edges(edges(spark, ("a", "b", "related", 1.0), ("b", "a", "related", 3.0), ("b", "a", "contains", None))).collect()]
    assert sorted(got) == [("a", "b", "related", 3.0), ("b", "a", "contains", None)]


def test_adjacency_and_pagerank(spark):
    n = nodes(spark, "a", "b")
    assert g.adjacency(edges(spark, ("a", "b", "contains", None)), n).select("src", "dst").collect() == [("a", "b")]
    assert g.adjacency(edges(spark, ("a", "b", "related", 1.0), ("a", "zz", "related", 1.0)), n).count() == 2
    r = {x["node_id"]: x["rank"] for x in g.pagerank(g.adjacency(edges(spark, ("a", "b", "contains", 1.0)), n), n).collect()}
    assert r["a"] == pytest.approx(0.350877, abs=1e-5) and sum(r.values()) == pytest.approx(1.0)


def test_paths(spark):
    n = nodes(spark, *"abcde")
    adj = g.adjacency(edges(spark, ("a", "b", "contains", 1.0), ("b", "c", "contains", 1.0), ("a", "d", "related", 1.0), ("d", "c", "related", 1.0)), n)
    assert g.shortest_path(adj, "a", "c") in (["a", "b", "c"], ["a", "d", "c"])
    assert g.shortest_path(adj, "a", "a") == ["a"] and g.shortest_path(adj, "a", "e") is None
    assert {(r["node_id"], r["depth"]) for r in g.k_hop(adj, nodes(spark, "b"), 2).collect()} == {("c", 1), ("d", 2)}


def test_weights():
    assert mt.normalize_weights({"keyword": 2, "tfidf": 2}) == {"keyword": 0.5, "tfidf": 0.5, "semantic": 0.0, "graph": 0.0}
    assert mt.normalize_weights({}) == mt.WEIGHTS


def test_tfidf(spark):
    d = spark.createDataFrame([(1, "optics law"), (2, "optics wave")], "id int, text string")
    post = mt.postings(d, "id", "text", [])
    v = mt.tfidf(post, "id", 2)
    s = mt.sparse_cosine(v.where("id = 1").withColumnRenamed("id", "q"), v, "q", "id").where("id = 2").first()
    assert s["score"] == pytest.approx(0.336097, abs=1e-5)


def test_idf_of_zero_counts_as_one(spark):
    d = spark.createDataFrame([(1, "heat heat law"), (2, "heat")], "id int, text string")
    c = tm.token_counts(d, "id", "text", [])
    k = tm.keywords(c, "id", [], [], 5, tm.idf(c, 2)).where("id = 1").orderBy("rank").collect()
    assert [(r["word"], round(r["score"], 6)) for r in k] == [("heat", 2.0), ("law", 0.693147)]


def test_full_text_overlapping_and_empty(spark):
    d = spark.createDataFrame([(1, None, "aaa b"), (2, "--- 第4页 ---\nxAAx", None)], "doc_id int, raw_text string, text string")
    got = [(r["doc_id"], r["page"], r["match_index"], r["score"]) for r in mt.full_text(d, "aa").orderBy("rank").collect()]
    assert got == [(1, 1, 0, 2), (1, 1, 1, 2), (2, 4, 1, 1)]
    assert mt.full_text(d, " ").count() == 0
    with pytest.raises(ValueError, match="long"):
        mt.full_text(d, "x" * 501)


def requests(spark):
    t0 = dt(2024, 1, 1)
    rows = [("a", "/x", t0 + timedelta(seconds=5 * k), k) for k in range(11)] + [("a", "/x", t0 + timedelta(seconds=60), 11), ("b", "/x", t0, 12), ("b", "/x", None, 13)]
    return spark.createDataFrame(rows, "client string, path string, ts timestamp_ntz, id int")


def test_rate_limit(spark):
    got = {r["id"]: r["allowed"] for r in rl.rate_limit(requests(spark), ["client", "path"], "ts", "id").collect()}
    assert got == {**dict.fromkeys(range(10), True), 10: False, 11: True, 12: True}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    requests(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(requests(spark).schema).parquet(str(tmp_path / "in"))
    q = rl.rate_limit_stream(s, ["client", "path"], "ts", "id").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r["allowed"] for r in spark.table("limited").collect()}
    assert got == {r["id"]: r["allowed"] for r in rl.rate_limit(requests(spark), ["client", "path"], "ts", "id").collect()}


def test_append_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc_id bigint, text string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in (0, 1):
        s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        rl.append_documents(s, str(tmp_path / "store"), str(tmp_path / f"cp{_}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "a.md").write_text("# Heat\n\ntext")
    (tmp_path / "b.txt").write_text("aGVsbG8gd29ybGQh")
    got = {r["name"]: (r["doc_type"], r["text"]) for r in src.read_text(spark, str(tmp_path / "*.*")).collect()}
    assert got == {"a.md": ("markdown", "# Heat\n\ntext"), "b.txt": ("text", "hello world!")}
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_text("broken")
    got = {r["name"]: r["raw_text"] for r in src.read_office(spark, str(tmp_path / "*.docx")).collect()}
    assert got == {"c.docx": "one\ntwo", "d.docx": ""}


def test_store_keeps_generations(spark, tmp_path):
    s = src.TableStore(spark, "file://" + str(tmp_path / "t"))
    assert s.load("x") is None
    for k in range(5):
        s.save("x", spark.range(k))
    assert s.load("x").count() == 4 and len(s._generations("x")) == 3
    with pytest.raises(ValueError, match="valid"):
        s.load("../x")


def test_communities(spark):
    n = nodes(spark, *"abcxyz")
    rows = [(p, q, "related", 1.0) for t in ("abc", "xyz") for p, q in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))]
    got = {r["node_id"]: r["community"] for r in g.label_propagation(g.adjacency(edges(spark, *rows), n), n).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("xyz", "x")}


def test_community_of_the_heavier_larger_label(spark):
    n = nodes(spark, *"abcdxyz")
    rows = [(p, q, "related", 5.0) for p, q in ("xy", "xz", "yz")] + [("a", "x", "related", 2.0), ("a", "y", "related", 2.0), ("a", "b", "related", 1.0), ("b", "c", "related", 5.0), ("b", "d", "related", 5.0), ("c", "d", "related", 5.0)]
    got = {r["node_id"]: r["community"] for r in g.label_propagation(g.adjacency(edges(spark, *rows), n), n).collect()}
    assert got["a"] == got["x"] == got["y"] == got["z"] != got["b"] == got["c"] == got["d"]


def test_communities_end_where_no_node_wants_to_move(spark):
    ids = [f"n{k:02d}" for k in range(30)]
    n = nodes(spark, *ids)
    # heavy links make one group of a chain of 15 nodes, a directed and an undirected link weigh the same
    rows = [(a, b, "related", 1.0) for a, b in zip(ids[:15], ids[1:15])] + [("n20", "n21", "related", 1.0), ("n20", "n22", "cite", 1.5)]
    got = {r["node_id"]: r["community"] for r in g.label_propagation(g.adjacency(edges(spark, *rows), n), n).collect()}
    assert len({got[i] for i in ids[:15]}) == 1
    assert got["n20"] == got["n22"] and all(got[i] == i for i in ids[23:])


def test_stats_of_an_empty_graph(spark):
    assert g.stats(nodes(spark).withColumn("node_type", F.lit("x")), edges(spark)).count() == 0


def test_catalog_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_flagship(spark):
    df = catalog.flagship(spark, SF)
    assert df.columns == ["query_id", "doc_id", "rank", "keyword", "tfidf", "semantic", "score"] and df.count() > 0


def test_headings_between_strides(spark, tmp_path):
    raw = "# a\ntext\n## b\nmore\n# c\nend"
    spark.createDataFrame([(1, raw), (2, ""), (3, None)], "doc_id bigint, raw_text string").write.parquet(f"{tmp_path}/documents.parquet")
    heads = [("a", 1, 1, 0, 19), ("b", 1, 2, 9, 19), ("c", 1, 1, 19, 26), ("far", 1, 1, 500, 900)]
    spark.createDataFrame([(*h, [], dt(2024, 1, 1)) for h in heads], "heading_id string, doc_id bigint, heading_level int, start_pos bigint, end_pos bigint, children array<string>, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/headings.parquet")
    got = {r["pos"]: r["heading_id"] for r in q_graph.heading_of_offset(spark, str(tmp_path)).collect()}
    assert got == {0: "a", 4: "a", 9: "b", 14: "b", 19: "c", 23: "c"}
