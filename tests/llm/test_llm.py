"""Operators for training data against brute force, round trips and their stated cases."""

import random
from datetime import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillgraph.llm import editor, mixing, packing, page_furniture, page_shapes, scan_repair, splitting, term_counts, tokens, visual_form
from quillgraph.llm.perceptron import Perceptron

TS = dt(2024, 1, 1)


# -- 1: term counts --------------------------------------------------------------------------------
BATCH = "rec_id string, doc_id bigint, term string, version timestamp_ntz, deleted boolean, other string"


def brute_counts(batches):
    now = {}
    for rows in batches:
        for rid, doc, term, v, dead, _ in rows:
            if rid is not None and (rid not in now or v > now[rid][2]):
                now[rid] = (doc, None if dead else term, v)
    out = {}
    for doc, term, _ in now.values():
        if doc is not None and term is not None:
            out.setdefault(term, []).append(doc)
    return {t: (len(d), len(set(d))) for t, d in out.items()}


def test_signed_deltas(spark):
    rng = random.Random(3)
    batches = []
    for b in range(3):
        rows = [(f"r{rng.randrange(40)}", rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", "hot", "hot", None]), dt(2024, 1, 1 + b, rng.randrange(24), rng.randrange(60), k), rng.random() < 0.1, "x") for k in range(30)]
        batches.append([*rows, (None, 1, "a", TS, False, "x")])
    counts = term_counts.TermCounts(spark, per_bucket=5)
    for n in range(3):
        counts.apply(spark.createDataFrame(batches[n], BATCH))
        want = brute_counts(batches[: n + 1])
        assert {r["term"]: (r["occurrences"], r["documents"]) for r in counts.terms().collect()} == want
    late = [("r1", 1, "a", dt(2023, 1, 1), False, "late")]
    counts.apply(spark.createDataFrame(late + batches[0], BATCH))  # repeated and stale rows change nothing
    assert {r["term"]: (r["occurrences"], r["documents"]) for r in counts.terms().collect()} == want
    again = term_counts.TermCounts.open(spark, counts.path, 5)
    assert {r["term"]: r["documents"] for r in again.terms().collect()} == {t: d for t, (_, d) in want.items()}
    counts.apply(spark.createDataFrame([], BATCH))
    assert counts.terms().count() == len(want)


def test_marks_and_normal_form(spark):
    rows = [(f"n{k}", k % 30, "　Common \t", TS, False, "") for k in range(30)] + [("x", 1, "rare", TS, False, ""), ("e", 1, "  ", TS, False, "")]
    df = spark.createDataFrame(rows, BATCH).withColumn("term", term_counts.normalize_term(F.col("term")))
    counts = term_counts.TermCounts(spark, per_bucket=3)
    counts.apply(df)
    assert {r["term"]: r["mark"] for r in counts.marked().collect()} == {"common": "common", "rare": "rare"}
    empty = term_counts.count_node_terms(spark.createDataFrame([], "node_id string, doc_id bigint, keyword string, ingested_at timestamp_ntz"))
    assert empty.marked().count() == 0


# -- 2: scanned text -------------------------------------------------------------------------------
SENTENCES = [
    "The careful measurement shows that catalytic momentum depends on residual temperature rather than on magnetic turbulence.",
    "Whenever the internal distribution remains constant, the longitudinal spectrum of the sample rises with thermal resistance.",
    "Students often confuse symmetric circuits with cellular hypotheses because both appear in the same steady-state experiment.",
    "测量结果表明，角向系数与概率矩阵的关系可以用实际数量来描述，供读者核对。",
    "图中给出了方差随未知量变化的曲线，单位见附录，问题的间隔由学生自己决定。",
]


def _clean_texts(n=60):
    rng = random.Random(4)
    return ["\n".join(" ".join(rng.choice(SENTENCES[:3]) for _ in range(3)) if k % 2 else "".join(rng.choice(SENTENCES[3:]) for _ in range(4)) for _ in range(6)) for k in range(n)]


@pytest.fixture(scope="module")
def layout():
    return Perceptron(page_furniture.train_layout(_clean_texts(), 3, pages_of=300))


def test_furniture_on_held_out_pages(layout):
    rng = random.Random(99)
    hit = false = missed = 0
    paras = [p for t in _clean_texts(20) for p in t.split("\n")]
    for _ in range(60):
        lines, truth, _, notices = page_furniture.set_pages([rng.choice(paras) for _ in range(8)], "optics workbook", rng)
        got = page_furniture.Layout(lines, notices).label(layout)
        hit += sum(got.get(i) == k for i, k in truth.items())
        missed += sum(got.get(i) != k for i, k in truth.items())
        false += sum(i not in truth for i in got)
    assert hit / (hit + missed) > 0.93 and false / (hit + false) < 0.05


def test_notices_do_not_depend_on_size(spark):
    edges = lambda rows: spark.createDataFrame(rows, "key string, n bigint, inner bigint, opening bigint")
    assert scan_repair.notices(edges([("copy", 2, 0, 0), ("once", 1, 0, 0), ("inner", 2, 9, 0)]), 6) == {"copy"}
    many = [("copy", 30, 0, 0), ("title", 60, 0, 55), ("few", 5, 0, 0)]
    assert scan_repair.notices(edges(many), 1200) == {"copy"} == scan_repair.notices(edges(many * 10), 12000)


def test_roman_and_misread_numbers():
    assert page_furniture.page_number("xxxiv")[1] == [("r", 34)]
    assert ("a", 322) in page_furniture.page_number("3Z2")[1]
    assert page_furniture.page_number("1.5  2.6") is None and page_furniture.page_number("1" * 4000) is None
    assert page_furniture.numbered_text("optics workbook     12")[0] == "optics workbook"


def test_gap_keys_meet_in_one_place():
    rng = random.Random(8)
    for n in (5, 9, 22, 23, 25, 26, 27, 28, 30, 90, 3000):
        for _ in range(20):
            w = "".join(rng.choice("abcdefghij") for _ in range(n))
            at, r, s = rng.randrange(n - 2), rng.choice((0, 1, 2)), rng.choice(("", "x", "xy"))
            v = w[:at] + s + w[at + r :]
            if len(v) >= 6:
                assert set(editor.gap_keys(w)) & set(editor.gap_keys(v)), (w, v)
    assert len(editor.gap_keys("a" * 100_000)) <= 10


def test_folds_and_outputs_undo_any_number_of_misreadings():
    inv, rng = editor.Inventory(), random.Random(2)
    words = "distributed conclusion measurement turbulence illustration windmill summary".split()
    same = total = 0
    for _ in range(400):
        w = rng.choice(words)
        read, outs = editor.spoil(w, inv, rng, rng.randint(1, 4))
        assert "".join(outs) == w and len(outs) == len(read)
        got = editor.outputs(read, w, inv)
        assert "".join(got) == w and len(got) == len(read)
        total, same = total + 1, same + bool(inv.fold(read) & inv.fold(w))
    assert same / total > 0.95
    long = "ab" * 2000
    assert "".join(editor.outputs(long[:100] + "x" + long[101:3000] + "yz" + long[3001:], long, inv)) == long


def _scans(seed=5, n=24):
    """Clean texts, and scans of others whose truth is known: (doc_id, raw_text, repaired text)."""
    rng, out = random.Random(seed), []
    for k in range(n):
        paras = [" ".join(rng.choice(SENTENCES[:3]) for _ in range(4)) for _ in range(3)]
        lines = []
        for p in paras:
            rest = "  " + p
            while len(rest) > 60:
                cut = rest.rfind(" ", 30, 61)
                lines.append(rest[:cut])
                rest = rest[cut + 1 :]
            lines.append(rest)
        bad = list(lines)
        for i in rng.sample(range(len(bad)), 3):
            words = bad[i].split(" ")
            j = rng.choice([x for x, w in enumerate(words) if len(w) > 6 and w.isalpha()] or [-1])
            if j >= 0:
                words[j] = editor.spoil(words[j], editor.Inventory(), rng)[0]
            bad[i] = " ".join(words)
        half = len(bad) // 2
        raw = [f"- {k + 3} -", *bad[:half], "--- 第2页 ---", f"- {k + 4} -", *bad[half:]]
        out.append((1000 + k, "\n".join(["--- 第1页 ---", *raw]), "\n".join(paras)))
    return out


def test_repaired_text_against_the_truth(spark):
    scans = _scans()
    rows = [(k, t, None, None) for k, t in enumerate(_clean_texts(80))] + [(d, None, raw, True) for d, raw, _ in scans] + [(None, None, scans[0][1], True), (5000, None, "", True), (5001, None, "\n \n\f", True), (5002, None, None, True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw_text string, is_scanned boolean").withColumn("key", F.lit("clash"))
    got = {r["doc_id"]: r for r in scan_repair.repair(docs).collect()}
    assert set(got) == {d for d, _, _ in scans} | {5001}
    assert got[5001]["text"] == "" and got[5001]["cases"] == []
    truth = {d: t for d, _, t in scans}
    right = sum(a == b for d, t in truth.items() for a, b in zip(got[d]["text"].split(), t.split()))
    total = sum(len(t.split()) for t in truth.values())
    assert right / total > 0.97
    assert all({c["kind"] for c in r["cases"]} >= {"page_number"} for d, r in got.items() if d in truth)
    assert scan_repair.scan_cases(scan_repair.repair(docs.limit(0))).count() == 0


# -- 3: splitting ----------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_cut_properties(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "字", "。", ". ", "\n", "\n\n", "x" * rng.randrange(60)]) for _ in range(300))
    limit, overlap = rng.randrange(5, 80), rng.randrange(0, 20)
    pieces = splitting.cut(3, len(text), limit, overlap, splitting.boundaries(text))
    assert pieces[0][0] == 3 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    over = min(overlap, limit - 1)
    assert all(p[1] - q[0] == over for p, q in zip(pieces, pieces[1:]))
    ends = {int(x) for _, w in splitting.boundaries(text) for x in w}
    for a, b, kind in pieces[:-1]:
        natural = [x for x in ends if a + over + 1 <= x <= a + limit]
        assert (kind == "hard") == (not natural) and (kind == "hard" or b in ends)


def test_cut_by_token_sums():
    import numpy as np

    text = "aa bb cc dd ee ff"
    sums = np.cumsum([0] + [1 if c == " " else 2 for c in text])
    pieces = splitting.cut(0, len(text), 11, 2, splitting.boundaries(text), sums)
    assert all(sums[b] - sums[a] <= 11 for a, b, _ in pieces) and pieces[-1][1] == len(text)


def test_items(spark):
    assert splitting.items_of(10, []) == [(0, 10)]
    assert splitting.items_of(10, [(2, None), (5, 4), (5, 7), (12, 13)]) == [(0, 2), (2, 5), (5, 7), (5, 10)]
    docs = spark.createDataFrame([(1, "pdf", "x" * 30), (2, "pdf", "x" * 10), (3, None, "x" * 99), (4, "pdf", None), (5, "pdf", ""), (None, "pdf", "x" * 99)], "doc_id bigint, doc_type string, raw_text string").withColumn("start_pos", F.lit(1))
    heads = spark.createDataFrame([("h", 1, 5, None, TS), ("h", 1, 6, 29, dt(2023, 1, 1)), (None, 1, 9, None, TS), ("g", 1, None, None, TS)], "heading_id string, doc_id bigint, start_pos bigint, end_pos bigint, ingested_at timestamp_ntz")
    limits = spark.createDataFrame([("pdf", 10, 2), ("docx", None, 1), (None, 5, 5)], "doc_type string, max_chars int, overlap_chars int")
    pieces = splitting.oversized_pieces(docs, heads, limits)
    assert [tuple(r) for r in splitting.oversized_items(pieces).collect()] == [(1, 5)]
    assert [(r["piece_start"], r["piece_end"]) for r in pieces.orderBy("piece_no").collect()] == [(5, 15), (13, 23), (21, 30)]
    assert splitting.oversized_pieces(docs.limit(0), heads.limit(0), limits).count() == 0


# -- 4: visual forms -------------------------------------------------------------------------------
def test_visual_form():
    v = visual_form.visual_form
    same = [("ｅｎｅｒｇｙ", "energy"), ("energ​y­", "energy"), ("ѕpеctrum", "spectrum"), ("énergie", "énergie"), ("10 Ω", "10 Ω"), ("　a b ", "a b"), ("Ⅳ", "IV"), ("eﬀect", "effect"), ("引⼒", "引力"), ("能量", "能量"), ("verzӧgern", "verzögern"), ("300 К", "300 K"), ("e​́", "é")]
    assert all(v(a) == v(b) for a, b in same)
    differ = [("x²", "x2"), ("①", "1"), ("½", "1/2"), ("™", "TM"), ("Energy", "energy"), ("resume", "résumé"), ("a₁", "a1"), ("a b", "a  b")]
    assert all(v(a) != v(b) for a, b in differ)
    assert v(None) is None and v("") == "" and v("​ 　") == ""
    assert len(v("ａ" * 100_000)) == 100_000


def test_lookalikes_of_many_scripts():
    v = visual_form.visual_form
    same = [("\u0251", "a"), ("\u0585", "o"), ("\u13aa", "A"), ("\ua4ee", "A"), ("\U0001d400", "A"), ("\u2215", "/"), ("\ufe63", "-"), ("\u043e\u0301", "\u00f3")]
    assert all(v(a) == v(b) for a, b in same)
    t = visual_form.Transducer({"a": "1", "ab": "2", "abc": "3"})
    assert t("abcab" + "a" + "x") == "321x"
    with pytest.raises(ValueError):
        visual_form._check({"A": "x", "a": "x"})
    with pytest.raises(ValueError):
        visual_form._check({"\u00b2": "2"})


def test_mapping_needs_one_pass():
    table = visual_form.compile_mapping()
    assert all(table.get(c, c) == c for to in table.values() for c in to)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aеοｂ ⼒́​É　Ⅱﬁ漢①") for _ in range(12))
        assert visual_form.visual_form(visual_form.visual_form(t)) == visual_form.visual_form(t)


def test_visual_pairs(spark):
    nodes = spark.createDataFrame([("n1", 1, "energy", TS), ("n2", 1, "ｅnergy", TS), ("n3", 1, "energy", TS), ("n3", 1, "old", dt(2023, 1, 1)), ("n4", None, "ｅnergy", TS), ("n5", 2, "еnergy", TS), ("n6", 1, None, TS), ("n7", 1, " ", TS), ("n8", 1, "​", TS)], "node_id string, doc_id bigint, content string, ingested_at timestamp_ntz")
    heads = spark.createDataFrame([("h1", 2, "energy", TS), ("h1", 2, "energy", TS)], "heading_id string, doc_id bigint, title string, ingested_at timestamp_ntz").withColumn("text", F.lit("clash"))
    got = {tuple(r) for r in visual_form.visual_pairs(visual_form.visual_classes(nodes, heads)).collect()}
    assert got == {("n1", "n2"), ("n2", "n3"), ("h1", "n5")}


def test_visual_groups_have_one_row_a_record(spark):
    rows = [(f"n{k}", 1, "energy" if k % 2 else "\uff45nergy", TS) for k in range(400)]
    nodes = spark.createDataFrame(rows, "node_id string, doc_id bigint, content string, ingested_at timestamp_ntz")
    heads = spark.createDataFrame([], "heading_id string, doc_id bigint, title string, ingested_at timestamp_ntz")
    g = visual_form.visual_groups(visual_form.visual_classes(nodes, heads))
    assert g.count() == 400 and visual_form.representative_pairs(g).count() == 1


def test_tokens_of_long_texts():
    enc = tokens.encoding()
    for t in ("word. " * 9000, "字词。" * 9000, "a" * 30000 + " b", "  \n" * 9000 + "x"):
        assert tokens.encode(t) == enc.encode_ordinary(t)


# -- 6: packing ------------------------------------------------------------------------------------
def test_pack(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "x")], "doc_id bigint, text string"))
    kinds = spark.createDataFrame([("short", 256), ("short", 512), ("long", 4096), ("none", None), (None, 5)], "container_kind string, capacity_tokens int")
    rows = packing.pack(docs.withColumn("n_tokens", F.lit(0)), kinds).collect()
    size = {r["doc_id"]: len(tokens.encode(r["text"])) for r in docs.where("doc_id >= 0").collect()}
    for kind, cap in (("short", 256), ("long", 4096)):
        own = [r for r in rows if r["container_kind"] == kind]
        fill, parts = {}, {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["token_end"] - r["token_start"]
            parts.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
        assert max(fill.values()) <= cap
        assert set(parts) == {d for d, n in size.items() if n}
        for d, spans in parts.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == size[d] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert size[d] > cap or len(spans) == 1
        assert sum(fill.values()) / (cap * len(fill)) > 0.85
    assert packing.pack(docs.limit(0), kinds).count() == 0


def test_hilbert_curve_is_a_walk():
    at = {tokens.hilbert_key((x, y, z), 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(at) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1])) == 1 for k in range(63))


# -- 7: mixing -------------------------------------------------------------------------------------
def test_sainte_lague():
    assert mixing.sainte_lague(7, {"a": 53, "b": 24, "c": 23}) == {"a": 3, "b": 2, "c": 2}
    brute = dict.fromkeys("abcd", 0)
    w = {"a": 0.43, "b": 0.31, "c": 0.2, "d": 0.06}
    for _ in range(997):
        k = max(w, key=lambda x: (w[x] / (2 * brute[x] + 1), -ord(x)))
        brute[k] += 1
    assert mixing.sainte_lague(997, w) == brute
    assert mixing.sainte_lague(10**12, {"a": 1.0, "b": 2.0, "c": 1.0}, {"b": 7}) == {"a": (10**12 - 6) // 2, "b": 7, "c": (10**12 - 7) // 2}
    assert mixing.sainte_lague(10, {"a": 1.0, "b": 1.0}, {"a": 2}) == {"a": 2, "b": 8}
    assert mixing.sainte_lague(5, {"a": 0.0}) == {"a": 0} and mixing.sainte_lague(5, {}) == {}


@pytest.mark.parametrize(("total", "per_shard"), [(None, 50_000), (20_000, 50), (10**9, 50_000)])
def test_mix(spark, total, per_shard):
    rng = random.Random(4)
    rows = [(k, rng.choice(["big", "big", "mid", "other"]), "word " * rng.randrange(5, 40)) for k in range(600)] + [(9000, "tiny", "word " * 300), (9001, None, "x"), (9002, "big", None), (9003, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("held", F.lit(1))
    goals = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2), (None, 0.1, 1), ("zero", None, 1)], "source_name string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, goals, total, per_shard=per_shard)
    most = {"big": 2, "mid": 3, "tiny": 4}
    got = mixture.collect()
    assert all(1 <= r["times"] <= most[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "tiny", "absent", "zero"} and rep["absent"]["mixture_tokens"] == 0
    for s in most:
        assert rep[s]["mixture_tokens"] == sum(r["n_tokens"] * r["times"] for r in got if r["source"] == s)
    if total is None:
        assert all(abs(rep[s]["actual_share"] - t / 0.9) < 0.02 for s, t in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)))
    if total == 10**9:
        # full to within a block and a document of the cap
        assert all(rep[s]["available_tokens"] * m - rep[s]["mixture_tokens"] < mixing.BLOCK + 301 for s, m in most.items())


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source_name string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, goals)
    assert mixture.count() == 0 and report.count() == 1


# -- 8: spam pages ---------------------------------------------------------------------------------
SPAM = [
    "\n".join(f"momentum www.shop-{k}.example/a/{k} #cheap energy" for k in range(9)),
    " > ".join(["Home", "Login", "buy heat", "Sitemap", "best optics", "Contact"] * 4),
    "; ".join(["SKU12345", "9.99", "red", "kit", "热门"] * 6),
    "cheap heat lessons answers heat cheap lessons answers heat. heat answers cheap lessons cheap heat answers. " * 4,
    "官方电流 低价复杂度 官方电流 低价复杂度 官方电流 官方电流 低价复杂度 官方电流 低价复杂度",
]
HONEST = [
    "The value of the current rises with heat. It is not clear why this is so.",
    "\n".join(f"{k}\t{k * 1.7:.2f}\t{k * 2.3:.2f}" for k in range(20)),
    "\n".join(f"[{k}] The author of this book shows that heat is lost to the wall. http://lib.example/{k}" for k in range(9)),
    "问：为什么电流会随着温度的增大而减小？\n答：日期与压力的记录列于表面之后，供读者核对。",
    "ab12" * 500,
]


def test_pages():
    flag = lambda t: (lambda p: p["chars"] > 0 and p["spam"] > 0.5 * p["chars"] and p["few"] >= 0.6 * p["spam"])(page_shapes.page_profile(t))
    assert [flag(t) for t in SPAM] == [True] * len(SPAM)
    assert [flag(t) for t in HONEST] == [False] * len(HONEST)
    assert not flag("") and not flag(" \n ")


def test_spam_pages(spark):
    rows = [(k, t) for k, t in enumerate(SPAM + HONEST)] + [(50, None), (None, SPAM[0]), (0, SPAM[0]), (60, SPAM[1] * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(None).cast("bigint"))
    got = sorted(r[0] for r in page_shapes.spam_pages(page_shapes.page_shapes(df)).collect())
    assert got == [*range(len(SPAM)), 60]


def test_shapes_know_no_language():
    flag = lambda t: (lambda p: p["chars"] > 0 and p["spam"] > 0.5 * p["chars"] and p["few"] >= 0.6 * p["spam"])(page_shapes.page_profile(t))
    honest = [
        "Измерение показало, что температура среды меняется медленно. Затем мы сравнили два образца и записали результат.\nНа следующий день опыт повторили.",
        "The mist comes in,\non quiet feet,\nand looks around.\nThen it goes.",
        "int main(void) {\n  int x = 5;\n  for (int i = 0; i < x; i++) {\n    printf(\"%d\", i);\n  }\n  return 0;\n}",
        "longitudinal respiration kinetic equilibrium linear viscosity concurrent pressure distributed integral asymptotic gradient",
    ]
    spam = ["The cheap shoes of the best buy shoes is the cheap shoes " * 40, "Buy the best cheap shoes here today. " * 40, "题库押题速成班, 押题速成班题库, 速成班题库押题, " * 12, "дешёвые часы купить часы дешёвые купить " * 30]
    assert not any(map(flag, honest)) and all(map(flag, spam))


def test_shape_groups(spark):
    df = spark.createDataFrame([(1, "Home\nCart\nLogin"), (2, "Home\nShop\nLogin"), (3, "A sentence that says something."), (None, None)], "doc_id bigint, text string")
    got = page_shapes.shape_groups(page_shapes.page_shapes(df)).collect()
    assert sum(r["n_pages"] for r in got) == 4 and sum(r["n_flagged"] for r in got) == 2


def test_mixing_fill_and_groups(spark):
    docs = spark.createDataFrame([(k, "a" if k % 3 else "b", "some words of text here " * (1 + k % 7)) for k in range(300)], "doc_id bigint, source string, text string")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("c", 1e-14, 1)], "source_name string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, goals, fill=0.8, per_shard=10)
    rep = {r["source"]: r for r in report.collect()}
    assert max(r["times"] for r in mixture.collect()) <= 3 and rep["a"]["most_repeats"] <= 2
    reach = sum(r["available_tokens"] * r["max_repeats"] for r in rep.values())
    assert abs(sum(r["mixture_tokens"] for r in rep.values()) - 0.8 * reach) < 0.05 * reach
