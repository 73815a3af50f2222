"""Small fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import similarity as sim
from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.plans import q_text


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,) if not isinstance(value, tuple) else value], ", ".join(f"{n} string" for n in "abc"[: len(value) if isinstance(value, tuple) else 1]))
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("折射定律是光学基本定律", ["折射定律"], ["折射定律", "是光", "光学", "学基", "基本", "本定", "定律"]),
        ("光的折射定律", ["折射定律"], ["光的", "的折", "折射", "射定", "定律"]),
        ("光学", ["折射定律"], []),
        ("since cost", ["cos", "sin", "tan"], ["sin", "ce", "cos"]),
        ("Heat [fs12] a B2", [], ["heat", "b2"]),
        ("", ["x1"], []),
        (None, ["x1"], None),
    ],
)
def test_dict_tokens(spark, text, terms, want):
    assert one(spark, text, tk.dict_tokens(F.col("a"), terms))[0] == want


def test_longest_term_wins(spark):
    assert one(spark, "heat capacity. heater", tk.dict_tokens(F.col("a"), ["heat", "heat capacity"]))[0] == ["heat capacity", "heat", "er"]


def test_splitters(spark):
    assert one(spark, "短。这是一个足够长的句子。", tk.sentences(F.col("a")))[0] == ["这是一个足够长的句子"]
    assert one(spark, "ab甲乙丙", tk.ngram_tokens(F.col("a")))[0] == ["甲乙", "乙丙", "甲乙丙", "ab"]
    assert one(spark, "x" * 25, tk.chunks(F.col("a"), 10, 3))[0] == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    long = "这是一个足够长的句子" * 3 + "。"
    packed = one(spark, long * 30, tk.packed_paragraphs(F.col("a"), 100))[0]
    assert all(len(p) <= 100 for p in packed) and "".join(packed) == long * 30


def test_cleaning(spark):
    assert one(spark, "概率模型概率模型概率模型概率模型 我们我们 testtest", tx.fold_ghosts(F.col("a")))[0] == "概率模型 我们我们 test"
    assert one(spark, "光学 law".encode().decode("latin-1"), tx.fix_mojibake(F.col("a")))[0] == "光学 law"
    assert one(spark, "déjà vu", tx.fix_mojibake(F.col("a")))[0] == "déjà vu"
    assert one(spark, "aGVsbG8gd29ybGQh", tx.decode_base64_text(F.col("a")))[0] == "hello world!"
    assert one(spark, "not base64, surely", tx.decode_base64_text(F.col("a")))[0] == "not base64, surely"
    assert one(spark, "a < b & \"c\" A", tx.highlight(F.col("a"), "a"))[0] == "<mark>a</mark> &lt; b &<mark>a</mark>mp; &quot;c&quot; <mark>A</mark>"
    assert one(spark, "x", tx.page_at(F.col("a"), F.lit(1)))[0] == 0
    assert one(spark, "--- 第3页 ---\nab", tx.page_at(F.col("a"), F.lit(14)))[0] == 3
    assert one(spark, "第2章　热学", tx.link_form(F.col("a")))[0] == "热学"


def test_similarity(spark):
    s = lambda a, b, t=(): one(spark, (a, b), sim.text_similarity(F.col("a"), F.col("b"), list(t)))[0]
    assert s("随机变量", "随机") == 0.75 and s("a", "a") == 1.0 and s(None, "a") == 0.0 and s("", "a") == 0.0
    assert s("光学", "热学") == 0.0
    assert one(spark, ("abcd", "zbcy"), sim.common_run(F.col("a"), F.col("b")))[0] == 2
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in v.select(sim.cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0, 0.0]
    e = one(spark, "a", sim.stub_embedding(F.col("a")))[0]
    assert len(e) == 64 and e[0] == 1.0 and set(e[1:]) == {0.0}
    assert set(one(spark, "", sim.stub_embedding(F.col("a")))[0]) == {0.0}


def test_heading_forms(spark):
    for line, kind, level in [("## Heat", "markdown", 2), ("第三章 热学", "chapter", 1), ("2.1.3 Heat flow", "section", 3), ("IV. Heat", "alphaRoman", 2), ("（一）热学", "bracketNumber", 4), ("plain text", None, None)]:
        form = tx.heading_form(F.col("a"))
        got = one(spark, line, form["kind"], tx.heading_level(form))
        assert tuple(got) == (kind, level)


def test_marked_heading_lines(spark, tmp_path):
    raw = "[fs18]7.1 sedimentary projection\n[fs9.5] x\n7.2 heat\n[bookmark:L0]Heat\n[fs12]12"
    spark.createDataFrame([(1, raw)], "doc_id bigint, raw_text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line_no"]: (r["kind"], r["title"], r["level"]) for r in q_text.heading_lines(spark, str(tmp_path)).collect()}
    assert got == {0: ("section", "sedimentary projection", 2), 2: ("section", "heat", 2), 3: ("bookmark", "Heat", 1)}
    assert [r["line_no"] for r in q_text.line_kinds(spark, str(tmp_path)).where("page_number").collect()] == [4]
