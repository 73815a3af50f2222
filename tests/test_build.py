"""Graph building, ideas, chunking, outlines and replies on small fixtures."""

from datetime import datetime as dt
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import chunking as ck
from quillgraph.functions import replies as rp
from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.operators import build, graph, ideas, matching, outline, terms
from quillgraph.operators import document_pass as dp
from quillgraph.operators import terms as tm
from quillgraph.sources import bundles

TS = dt(2024, 1, 1)
NODE = "node_id string, doc_id bigint, node_type string, content string, weight double, aliases array<string>"
EDGE = "from_id string, to_id string, edge_type string, weight double, link_method string, ingested_at timestamp"


def test_positions_of_a_column(spark):
    df = spark.createDataFrame([("a.b.a.b", "a.b"), ("xx", ""), ("none", "y"), ("q\\Eq\\E", "\\E")], "h string, n string")
    got = [r[0] for r in df.select(matching.first_positions(F.col("h"), F.col("n"), 10)).collect()]
    assert got == [[0, 4], [], [], [1, 4]]
    assert spark.createDataFrame([("abab" * 9, "ab")], "h string, n string").select(F.size(matching.first_positions(F.col("h"), F.col("n"), 3))).first()[0] == 3


def test_merge_concepts(spark):
    nodes = spark.createDataFrame(
        [("a", 1, "entity", "harmonic field", 0.2, None), ("b", 1, "entity", "harmonic field", 0.9, ["hf"]), ("c", 2, "entity", "harmonic field", 0.5, None), ("d", None, "concept", "harmonic field", 0.1, None), ("e", 1, "heading", "harmonic field", 0.5, None), ("f", None, "concept", "heat", None, None), ("g", None, "concept", "warmth", None, None), ("h", 3, "entity", None, None, None)],
        NODE,
    )
    edges = spark.createDataFrame([("b", "c", "related", 1.0, None, TS), ("a", "b", "is", 1.0, None, TS), ("f", "g", "of", 1.0, None, TS), ("e", "b", "contains", 2.0, None, TS)], EDGE)
    alias = spark.createDataFrame([("heat", "warmth"), (None, "x")], "content string, alias string")
    n, e, merged = build.merge_concepts(nodes, edges, ["harmonic", "field"], alias)
    into = {r["node_id"]: r["into"] for r in merged.collect()}
    # entities of two documents stay apart; the concept goes to the smallest it may join
    assert into == {"b": "a", "d": "a", "g": "f"}
    left = {r["node_id"]: r for r in n.collect()}
    assert set(left) == {"a", "c", "e", "f", "h"} and left["a"]["weight"] == 0.9 and left["a"]["aliases"] == ["hf"] and left["f"]["aliases"] == ["warmth"]
    assert {(r["from_id"], r["to_id"]) for r in e.collect()} == {("a", "c"), ("e", "a")}
    assert build.merge_concepts(nodes.limit(0), edges.limit(0), [])[2].count() == 0


def test_cross_links_against_brute_force(spark):
    rows = [(f"d{k}", k, "document", f"notes {k}.pdf", None, None) for k in range(4)]
    words = ["harmonic field", "harmonic fields", "entropy", "entropy law", "谐振频率", "谐振频率表"]
    rows += [(f"n{k}", k % 4, "entity", words[k % 6], None, None) for k in range(24)]
    nodes = spark.createDataFrame(rows, NODE)
    rel = build.document_relevance(nodes, spark.createDataFrame([(0,), (1,)], "doc_id bigint"), []).collect()
    assert all(r["doc_a"] < r["doc_b"] and (r["doc_a"] in (0, 1) or r["doc_b"] in (0, 1)) for r in rel) and len(rel) == len({(r["doc_a"], r["doc_b"]) for r in rel})
    links = build.cross_links(nodes, build.document_relevance(nodes, spark.createDataFrame([(0,), (1,)], "doc_id bigint"), []), [], most=25).collect()
    assert len(links) == 25 and sorted(r["order"] for r in links) == list(range(1, 26))
    assert all(r["sim"] >= 0.18 for r in links)
    relevance = [r["relevance"] for r in sorted(links, key=lambda r: r["order"])]
    assert relevance == sorted(relevance, reverse=True)


def test_display_report_and_visibility(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.0)], "node_id string, rank double")
    got = {r["node_id"]: (r["size"], r["is_hub"]) for r in build.node_display(ranks).collect()}
    assert got == {"a": (30.0, True), "b": (pytest.approx(12.4), False), "c": (8.0, False)}
    tree = spark.createDataFrame([("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("x", None)], "item_id string, path array<string>")
    edges = spark.createDataFrame([("a", "b", "contains"), ("b", "c", "contains")], "from_id string, to_id string, edge_type string")
    seen, e = build.visible_tree(tree, spark.createDataFrame([("a",)], "node_id string"), edges)
    assert {r[0] for r in seen.collect()} == {"a", "b"} and e.count() == 1


def test_ideas(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    moves = spark.createDataFrame([("a", "c"), ("c", "a"), ("b", "b"), ("a", "z")], "child string, parent string")
    assert {(r["child"], r["parent"]): r["cycle"] for r in ideas.makes_cycle(links, moves).collect()} == {("a", "c"): True, ("c", "a"): False, ("b", "b"): True, ("a", "z"): False}
    assert {r[0] for r in ideas.subtree(links, spark.createDataFrame([("b",)], "node_id string")).collect()} == {"b", "c"}
    i = spark.createDataFrame([("a", ["n1"]), ("b", None)], "idea_id string, related array<string>")
    ch = spark.createDataFrame([("a", "n2", "link"), ("a", "n1", "unlink"), ("b", "n1", "link"), ("b", "n1", "link"), ("q", "n1", "link")], "idea_id string, node_id string, op string")
    assert {r["idea_id"]: r["related"] for r in ideas.link_nodes(i, ch).collect()} == {"a": ["n2"], "b": ["n1"]}
    names = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, name string")
    taken = spark.createDataFrame([("x",), ("x (4)",)], "name string")
    assert {r["id"]: r["free"] for r in ideas.free_names(names, taken).collect()} == {1: "x (5)", 2: "x (6)", 3: "y"}
    d = spark.createDataFrame([("t1", "One", "first", "A {{x}}"), ("t2", "Two", "second", "B")], "task string, name string, description string, template string")
    o = spark.createDataFrame([("t1", "mine", False), ("t2", " ", None), ("t3", "x", True)], "task string, template string, enabled boolean")
    got = {r["task"]: (r["template"], r["custom"], r["enabled"]) for r in ideas.effective_prompts(d, o).collect()}
    assert got == {"t1": ("mine", True, False), "t2": ("B", False, True)}
    assert ideas.effective_prompts(d, o, "SECOND").count() == 1
    w = spark.createDataFrame([(" ", "c"), ("t" * 201, "c"), ("t", "c" * 100_001), ("t", None), (None, "c")], "t string, c string")
    assert [r[0] for r in w.select(ideas.idea_problem(F.col("t"), F.col("c"))).collect()] == ["title", "title", "content", None, "title"]


def test_chunks():
    assert ck.pack("", 10, 2) == [] and ck.pack("  short ", 10, 2) == ["short"]
    text = "\n\n".join(f"paragraph {k} " + "word " * 10 for k in range(12))
    chunks = ck.pack(text, 200, 40)
    assert all(len(c) <= 200 for c in chunks) and all(f"paragraph {k} " in "".join(chunks) for k in range(12))
    hard = ck.pack("x" * 1000, 200, 40)
    assert [len(c) for c in hard] == [200] * 6 + [40] and "x" * 1000 in "x" * 1240
    noisy = "--- 第3页 ---\n12\n1 Field 5\n2 Heat 9\n. . . . .\n∫ f dx\n[fs18]Heat\nA line of text that is long enough to stay.\nnext"
    assert ck._clean(noisy).split("\n") == ["[fs18]Heat", "A line of text that is long enough to stay.", "next"] or "[fs18]Heat" in ck._clean(noisy)


def test_exam_and_textbook(spark):
    exam = "期末考试试卷\n姓名：\n1. 选择题\n" + "1. 问题一的内容是什么\n继续\n2. 问题二\n第 1 页 / 共 2 页\n" + "x" * 200 + "\n参考答案\n1. 答案"
    df = spark.createDataFrame([(1, exam), (2, "第1章 光\n1.1 反射 " + "\n" + "y" * 30 + "\n第2章 热\n" + "z" * 60), (3, None), (4, "")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in df.where(ck.is_exam_paper(F.col("text"))).collect()] == [1]
    q = ck.exam_questions(df).orderBy("ord").collect()
    assert [r["question"].split("\n")[0] for r in q] == ["问题一的内容是什么", "问题二"] and q[0]["section"] == "1. 选择题" and "继续" in q[0]["question"]
    b = ck.textbook_sections(df.where("doc_id = 2")).orderBy("ord").collect()
    assert [(r["chapter"], r["title"]) for r in b] == [("1", "1.1 反射"), ("2", "热")]


def test_outline(spark):
    body = "这一段正文比标题长得多，讲的是这一节的内容，供读者阅读和参考，所以不会被当作标题。" * 2
    text = f"目录\n第一章 光学 ...... 1\n第二章 热学 ...... 9\n\n\n\n\n{body}\n{body}\n{body}\n{body}\n{body}\n{body}\n{body}\n{body}\n第一章 光学\n{body}\n1.1\n反射定律的内容\n{body}\n{body}\n第二章 热学\n{body}\n2.1 Lecture notes on\nProbability Theory\n{body}\n第一章 光学\n{body}"
    got = outline.headings_of(text)
    assert [(h[0], h[1]) for h in got] == [(1, "第一章 光学"), (2, "1.1 反射定律的内容"), (1, "第二章 热学"), (2, "2.1 Lecture notes on Probability Theory")]
    assert [h[5] for h in got] == [-1, 0, -1, 2] and got[0][4] >= got[1][4] and text[got[1][3] :].startswith("1.1")
    assert outline.rejected("不不不不不") == "repeats" and outline.rejected("参考答案") == "solution" and outline.rejected("Theorem 3") == "label" and outline.rejected("notes of the") == "fragment" and outline.rejected("反射定律") is None
    df = spark.createDataFrame([(1, text), (2, None), (None, text), (3, "")], "doc_id bigint, raw_text string").withColumn("title", F.lit("clash"))
    assert outline.outline(df).count() == 4
    marks = spark.createDataFrame([(1, 0, 1, "x", "bookmark", 0, 9, None)], outline.outline(df).schema)
    assert outline.with_bookmarks(outline.outline(df), marks).count() == 1


def test_pages_and_headings_in_one_pass(spark):
    text = "a\n--- 第2页 ---\nb\n--- 第3页 (OCR) ---\nc"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id bigint, raw_text string")
    pts = spark.createDataFrame([("h0", 1, 0), ("h1", 1, 15), ("h2", 1, len(text)), ("h3", 2, 2), ("h4", 3, 0)], "heading_id string, doc_id bigint, start_pos bigint")
    marks = docs.where("raw_text is not null").select("doc_id", F.explode_outer(tx.page_marks(F.col("raw_text"))).alias("m")).select("doc_id", "m.pos", "m.page")
    assert {r[0]: r[1] for r in tx.page_asof(pts, marks).collect()} == {"h0": 0, "h1": 2, "h2": 3, "h3": 0}
    heads = spark.createDataFrame([("a", 1, 1, 0, 50), ("b", 1, 2, 10, 20), ("c", 1, 2, 10, 30), ("d", 1, None, 0, 90), ("e", 1, 3, 9, 9)], "heading_id string, doc_id bigint, heading_level int, start_pos bigint, end_pos bigint")
    p = spark.createDataFrame([(1, 0), (1, 15), (1, 25), (1, 60), (1, 95), (2, 0), (None, 1)], "doc_id bigint, pos bigint")
    assert {r["pos"]: r["heading_id"] for r in graph.heading_at(p, heads).collect()} == {0: "a", 15: "c", 25: "c", 60: "d"}


def test_replies(spark):
    deep = "prose [x " + "[" * 5000 + '```json\n["反向传播", "卷积层", "卷积层"]\n``` more'
    assert rp.find_json(deep) == ["反向传播", "卷积层", "卷积层"] and rp.terms_of(deep) == ["反向传播", "卷积层"]
    assert rp.find_json('say "[\\"a\\"]" and {"k": [1]}', "{") == {"k": [1]} and rp.find_json("nothing") is None and rp.find_json(None) is None
    assert rp.terms_of("terms: heat, light；wave") == ["heat", "light", "wave"] and rp.terms_of('[{"term": "a1"}, {"name": "b1"}, 3]') == ["a1", "b1"]
    assert rp.terms_of('["a", "b", "a", "b", "c"]') == ["a", "b"]
    ts = ["heat", "light", "wave", "field", "noise"]
    assert rp.refined(ts, '[{"index": 1, "keep": false}, {"index": 2, "rename": "lights"}]') == ["lights", "wave", "field", "noise"]
    assert rp.refined(ts, '[{"index":1,"keep":false},{"index":2,"keep":false},{"index":3,"keep":false}]') == ts and rp.refined(ts[:3], "[]") == ts[:3]
    x = rp.extraction("the heat law", '{"headings":[{"level":9,"title":"heat","start":0}],"entities":[{"term":"heat","specificity":"x"},{"term":"law"}],"relations":[{"from":"heat","to":"law","weight":3},{"from":"heat","to":"heat"}]}')
    assert x["headings"] == [{"level": 6, "title": "heat", "start": 4}] and x["entities"][0]["specificity"] == 5 and [r["weight"] for r in x["relations"]] == [1]
    df = spark.createDataFrame([('["ab"]',), (None,), ('{"docType": "exam"}',)], "r string")
    assert [r[0] for r in df.select(rp.reply_terms(F.col("r"))).collect()][:2] == [["ab"], []]
    assert [tuple(r[0]) for r in df.select(rp.document_kind(F.col("r"))).collect()] == [("other", ""), ("other", ""), ("exam", "")]
    m = spark.createDataFrame([("openai", "", "ftp://x", "gpt-4o-mini"), ("ollama", None, None, "qwen 7b"), (None, "k", "http://x", "odd")], "p string, k string, u string, m string")
    got = m.select(rp.warnings(F.col("p"), F.col("k"), F.col("u")), rp.is_cloud(F.col("p")), rp.model_size(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(["key", "url"], True, "large"), ([], False, "small"), (["provider"], False, "medium")]
    one = spark.range(1)
    assert one.select(rp.upper_median(F.array(*map(F.lit, (0, 4, 2, 9, 3)))), rp.most_terms(F.lit(60_000)), rp.is_exam(F.lit(True), F.lit(True), F.lit(0.6))).first()[:] == (4, 120, False)
    unit = [F.lit(v) for v in (1, 0, 0, 1, 5, 6)]
    assert one.select(*rp.affine(unit, unit)).first()[:] == (1, 0, 0, 1, 10, 12)


def test_ranking_of_terms(spark):
    assert terms.without_overlaps([("field", 1.0), ("harmonic field", 0.9), ("heat", 0.5), ("at", 0.4)], 9) == [("harmonic field", 1.0), ("heat", 0.5)]
    s = spark.createDataFrame([(1, "谐振", 1.0, 0.0), (1, "谐振场", 1.0, 3.0), (1, "弱谐振", 1.0, 0.0), (1, "力学", 1.0, None)], "k int, word string, score double, pmi double")
    got = {r["word"]: round(r["score"], 4) for r in terms.boosted(s, "k", ["学"]).collect()}
    assert got == {"谐振": 0.7, "谐振场": 1.32, "弱谐振": 1.2, "力学": 1.5}


def test_bundles_and_blobs(spark, tmp_path):
    blobs = bundles.BlobStore(spark, f"file://{tmp_path}/blobs")
    blobs.put("a1", b"\x00one")
    blobs.put("a1", b"\x00two")
    assert blobs.get("a1") == b"\x00two" and blobs.get("none") is None and [r["id"] for r in blobs.all().collect()] == ["a1"]
    assert blobs.delete("a1") and not blobs.delete("a1")
    with pytest.raises(ValueError):
        blobs.get("../a1")
    docs = spark.createDataFrame([(1, "x.pdf", 7), (2, "y.pdf", 8)], "doc_id bigint, doc_name string, project_id int")
    t = {
        "documents": docs,
        "graph_nodes": spark.createDataFrame([("n1", 1), ("n2", 1), ("n3", 2), ("n4", None)], "node_id string, doc_id bigint"),
        "graph_edges": spark.createDataFrame([("n1", "n2", "is"), ("n1", "n3", "is")], "from_id string, to_id string, edge_type string"),
        "headings": spark.createDataFrame([("h", 2)], "heading_id string, doc_id bigint"),
    }
    path = f"file://{tmp_path}/bundle"
    bundles.export_project(t, {"project_name": "Optics"}, 7, path)
    project, got = bundles.import_project(spark, path, spark.createDataFrame([("Optics",)], "name string"), 9)
    assert project == {"project_name": "Optics (2)", "project_id": 9}
    assert {k: v.count() for k, v in got.items()} == {"documents": 1, "graph_nodes": 2, "graph_edges": 1, "headings": 0} and got["documents"].first()["project_id"] == 9
    more = bundles.add_samples(spark.createDataFrame([(5, "x.pdf", 1), (6, "z.pdf", 1), (7, "z.pdf", 1)], docs.schema), docs)
    assert sorted(r["doc_id"] for r in more.collect()) == [1, 2, 6]
    with pytest.raises(PermissionError):
        bundles.clear_all(spark, [path], "t", "u")


def test_section_matches(spark):
    q = spark.createDataFrame([(1, "the harmonic field law", {"field": 2.0, "law": 1.0})], "q int, text string, words map<string,double>")
    s = spark.createDataFrame([(10, "harmonic field", {"field": 1.0}), (11, "other words", {}), (12, "the law", {"law": 3.0}), (13, None, {})], "s int, text string, words map<string,double>")
    got = {r["s"]: (round(r["overlap"], 4), r["rank"]) for r in matching.section_matches(q, s, "q", "s", []).collect()}
    assert got == {10: (0.3333, 1), 12: (0.3333, 2)}


def test_mojibake_and_ghosts(spark):
    bad = "电场 law".encode().decode("latin-1") + " 中"
    df = spark.createDataFrame([(bad, "光光光的的的 heatheat 波动波动波动波动"), (None, None), ("é", "")], "t string, g string")
    got = df.select(tx.fix_mojibake(F.col("t")), tx.fold_ghosts(F.col("g"))).collect()
    assert [r[0] for r in got] == ["电场 law 中", None, "é"] and got[0][1] == "光的 heat 波动"


def test_document_graph(spark):
    text = "harmonic field theory is a long first paragraph of this text about the field.\n\nentropy grows whenever the harmonic field is weak in this second paragraph.\n\n折射定律是光学的基础内容和重要的部分，折射定律与反射现象的关系需要说明清楚。反射现象，也很常见的内容。"
    docs = spark.createDataFrame([(1, "a.pdf", text, "[fs18]Fields\n" + text), (2, "b.pdf", "", None), (3, "c.pdf", None, None), (None, "d.pdf", text, None)], "doc_id bigint, doc_name string, text string, raw_text string")
    heads = spark.createDataFrame([("h1", 1, 0, 1, "[fs18]Fields", 0, 500, None, TS), ("h9", 9, 0, 1, "x", 0, 5, None, TS)], "heading_id string, doc_id bigint, ord int, heading_level int, title string, start_pos bigint, end_pos bigint, children array<string>, ingested_at timestamp")
    n, e = build.document_graph(docs, heads, ["harmonic field", "entropy", "折射定律", "反射现象"], ["the"])
    nodes = n.collect()
    assert {r["node_id"] for r in nodes if r["node_type"] != "entity"} == {"doc_1", "doc_2", "doc_3", "h1"}
    names = {r["content"]: r["node_id"] for r in nodes if r["node_type"] == "entity"}
    assert {"harmonic field", "entropy", "折射定律", "反射现象"} <= set(names) and not any("fs18" in (r["content"] or "") for r in nodes if r["node_type"] == "entity")
    edges = {(r["from_id"], r["to_id"], r["edge_type"]) for r in e.collect()}
    assert ("doc_1", "h1", "hierarchy") in edges and ("h1", names["entropy"], "contains") in edges
    assert any(k == "co-occurrence" for _, _, k in edges) and any(k == "relates" for _, _, k in edges)
    ids = {r["node_id"] for r in nodes}
    assert all(a in ids and b in ids for a, b, _ in edges)


def test_document_graph_longest_entities(spark):
    """Of a sentence with more than ten entities the ten longest are linked (before: those with the smallest ids)."""
    terms = [c * k for k, c in enumerate("abcdefghijkl", 4)]
    docs = spark.createDataFrame([(1, "a", " ".join(terms), None), (2, "b", "another text of nothing else", None)], "doc_id bigint, doc_name string, text string, raw_text string")
    heads = spark.createDataFrame([], "heading_id string, doc_id bigint, ord int, heading_level int, title string, start_pos bigint, end_pos bigint, children array<string>, ingested_at timestamp")
    n, e = build.document_graph(docs, heads, terms, [])
    names = {r["node_id"]: r["content"] for r in n.collect()}
    linked = [{names[r["from_id"]], names[r["to_id"]]} for r in e.where("edge_type = 'co-occurrence'").collect() if names[r["from_id"]] in terms]
    assert len(linked) == 45 and set().union(*linked) == set(terms[2:])


def test_document_pass(spark):
    """One pass says what the Column functions and joins say; a document of several rows is one."""
    terms = ["ph值", "折射定律", "折射", "field", "a; b", "harmonic field", "反射现象"]
    long = "折射定律与反射现象的关系是光学的内容，PH值 of the Harmonic Field 不同，fields 0x1, 反射现象　"
    texts = [f"{long}\n \t\n{long}。{long}\n\n {long};{long}\r\n", f"{long}\n{long}", "\n　x\n", "[fs12.5]harm[fs3]onic field; a; b a; b折射反折 [bookmark:L3]", "", f"{long}A\n\x0b\n" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [dp.paragraphs(t) for t in texts] == [r[0] for r in df.orderBy("doc_id").select(tk.paragraphs(F.col("text"))).collect()]
    got = df.select("doc_id", tk.dict_matches(F.col("text"), terms).alias("found")).mapInArrow(partial(dp.counted, terms=set(terms)), dp.COUNTS)
    want = tm.token_counts(df, "doc_id", "text", terms).where(F.col("token").isin(terms) | ~F.col("token").rlike("^[一-龥]{2}$"))
    assert sorted(got.select("doc_id", "token", "tf").collect()) == sorted(want.select("doc_id", "token", "tf").collect())
    said = df.select("doc_id", F.posexplode(tk.sentences(F.lower("text"))).alias("ord", "s")).select("doc_id", "ord", F.explode(tk.dict_tokens(F.col("s"), terms)).alias("t")).distinct()
    places = {t: k for k, t in enumerate([*terms, "harmonic", "fields", "0x1", "of"])}
    units = []
    for r in df.select("doc_id", F.lower("text").alias("low"), tk.sentence_matches(F.lower("text"), terms).alias("m")).collect():
        d = pa.array(r["m"], pa.string()).dictionary_encode()
        held = dp.Matches(d.dictionary.to_pylist(), set(terms), {"折射"}).units(r["low"], d.indices.to_numpy(), places)
        units += [(r["doc_id"], u, k) for u, k in zip(*map(list, held.nonzero()))]
    assert sorted(units) == sorted((r["doc_id"], r["ord"], places[r["t"]]) for r in said.collect() if r["t"] in places)
    heads = spark.createDataFrame([(f"h{d}{k}", d, k, k % 3, "t", s, e, None, TS) for d in (0, 9) for k, (s, e) in enumerate([(0, 400), (3, 9), (60, 200), (60, 90), (100, None)])], "heading_id string, doc_id bigint, ord int, heading_level int, title string, start_pos bigint, end_pos bigint, children array<string>, ingested_at timestamp")
    rows = [(d if d < 5 else 0, "n", t, "ab" + t) for d, t in enumerate(texts)]
    n, e = build.document_graph(spark.createDataFrame(rows, "doc_id bigint, doc_name string, text string, raw_text string"), heads, terms, ["of"])
    ents = {(r["doc_id"], r["content"]): r["node_id"] for r in n.where("node_type = 'entity'").collect()}
    body = df.select(F.when(F.col("doc_id") < 5, F.col("doc_id")).otherwise(0).alias("doc_id"), F.lower("text").alias("text")).where("text <> ''")
    around = build.entity_headings(spark.createDataFrame(list(ents), "doc_id bigint, content string"), body.select("doc_id", F.concat(F.lit("ab"), "text").alias("raw_text")), heads)
    around = {(r["doc_id"], r["content"]): r["heading_id"] for r in around.collect()}
    assert around and {(r["to_id"], r["from_id"]) for r in e.where("edge_type = 'contains'").collect()} == {(i, around.get(k, f"doc_{k[0]}")) for k, i in ents.items()}
    rel = graph.pattern_relations(body.select("doc_id", F.explode(tk.clauses(F.col("text"))).alias("c")).where("length(c) >= 10"), "c", "doc_id")
    rel = {(ents[d, a], ents[d, b], k, w) for d, a, b, k, w, _ in rel.collect() if (d, a) in ents and (d, b) in ents}
    assert rel and rel == {tuple(r) for r in e.where("edge_type not in ('contains', 'hierarchy', 'co-occurrence')").select("from_id", "to_id", "edge_type", "weight").collect()}
    assert e.groupBy("from_id", "to_id", "edge_type").count().where("count > 1").isEmpty()
