"""Nearest documents, index candidates and pairs counted where they lie, against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.functions import tokens as tk
from quillgraph.operators import matching, nearest, terms


def _docs(n):
    r = random.Random(5)
    return [(k, " ".join(r.choice("aa bb cc dd ee ff gg 引力波动方程 力学 zz9".split()) for _ in range(r.randint(0, 12)))) for k in range(n)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_makes_no_pairs(spark, monkeypatch):
    """In several passes and blocks it finds what all pairs would give, and its plan joins no tokens."""
    monkeypatch.setattr(nearest, "PASS_ROWS", 4)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 2)
    rows = _docs(40)
    d = spark.createDataFrame(rows, "id bigint, text string")
    t = {k: Counter(x) for k, x in d.select("id", tk.dict_tokens(F.col("text"), [])).collect()}
    df = Counter(w for c in t.values() for w in c)
    v = {k: {w: n / sum(c.values()) * (math.log(41 / (df[w] + 1)) + 1) for w, n in c.items()} for k, c in t.items()}
    norm = {k: math.sqrt(sum(x * x for x in c.values())) for k, c in v.items()}
    score = {"tfidf": lambda a, b: sum(v[a][w] * v[b][w] for w in v[a].keys() & v[b]) / norm[a] / norm[b], "keyword": lambda a, b: len(t[a].keys() & t[b]) / len(t[a].keys() | t[b])}
    for layer, f in score.items():
        got = nearest.nearest(d, d.where("id % 4 = 0"), "id", "text", [], {layer: 1.0}, 3)
        assert "Join" not in _plan(got)
        want = {(q, b, k + 1) for q in range(0, 40, 4) for k, b in enumerate(sorted((b for b in t if t[q].keys() & t[b]), key=lambda b: (-round(f(q, b), 9), b))[:3])}
        assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def test_hybrid_layers_add_up(spark):
    d = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "dd")], "id bigint, text string")
    graph = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "query_id bigint, id bigint, score double")
    got = {r.id: r for r in matching.hybrid(d, d.where("id = 1"), "id", "text", [], graph=graph).collect()}
    assert set(got) == {1, 2} and got[2].graph == 0.5 and got[1].graph == 0
    assert abs(got[2].score - (0.2 * got[2].keyword + 0.3 * got[2].tfidf + 0.3 * got[2].semantic + 0.1)) < 1e-12 and abs(got[2].keyword - 1 / 3) < 1e-12


def test_window_pairs_need_no_join(spark):
    rows = [(["a", "b", "a", "c", "d", "e"],), (["a"],), ([],), (["d", "d"],)]
    got = terms.window_pairs(spark.createDataFrame(rows, "tokens array<string>").repartition(2), "tokens", 2)
    want = Counter((u[i], u[j]) for (u,) in rows for i in range(len(u)) for j in range(len(u)) if i != j and abs(i - j) <= 2)
    assert {(r.a, r.b): r.n for r in got.collect()} == want
    assert "Join" not in _plan(got)


def test_dictionary_pattern_of_many_terms(spark):
    words = [chr(97 + i) + chr(97 + j) + x for i in range(26) for j in range(0, 26, 5) for x in ("", "-x", "^]")] + ["引力", "引力波", "+["]
    text = "aaaf-xzz引力波af^]+[ Aa 引力学说"
    got = spark.createDataFrame([(text,)], "t string").select(tk.dict_tokens(F.col("t"), words)).first()[0]
    assert got == ["aa", "af-x", "zz", "引力波", "af^]", "+[", "aa", "引力"]


def test_candidates_of_many_equal_items(spark):
    """Items of the same keys are joined once; the k best are those of all pairs, in one pass or several."""
    texts = ["aa", "aa bb", "bb cc", "引力波", "引力", "", "dd"]
    q = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate([*texts, "aa bb cc 引力", "nothing"])], "q string, text string")
    i = spark.createDataFrame([(f"i{k:02}", texts[k % len(texts)]) for k in range(60)], "i string, text string")
    keys = lambda df: {r[0]: set(r[1]) for r in df.select(df.columns[0], matching.index_tokens(F.col("text"), [])).collect()}
    a, b = keys(q), keys(i)
    want = {(x, y, len(a[x] & b[y])) for x in a for y in sorted((y for y in b if a[x] & b[y]), key=lambda y: (-len(a[x] & b[y]), y))[:5]}
    assert {tuple(r) for r in matching.index_candidates(q, i, "q", "i", "text", [], 5).collect()} == want
    side = lambda df: df.select(df.columns[0], matching.index_tokens(F.col("text"), []).alias("keys"))
    assert {tuple(r) for r in nearest.most_shared(side(q), side(i), "q", "i", 5, 2).collect()} == want


def test_sentences_of_questions_write_no_grams(spark):
    q = spark.createDataFrame([(1, 0, "引力波方程是什么 wave"), (2, 3, "none here")], "doc_id bigint, question int, text string")
    s = spark.createDataFrame([(1, 0, "引力波方程很美"), (1, 1, "wave motion"), (1, 2, "other words"), (3, 0, "wave")], "doc_id bigint, ord int, text string")
    got = matching.question_sentences(q, s, ["is"])
    assert [(r.doc_id, r.question, r.ord, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 0, 0, 1), (1, 0, 1, 2)]
    assert "Join" not in _plan(got)
