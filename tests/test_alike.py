"""Pairs that are alike, found by keys, against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from quillgraph.functions import similarity as sim
from quillgraph.operators import alike, build


def _texts(spark, n):
    """Many texts with one common word, and texts of all lengths that differ in little."""
    r = random.Random(5)
    words = ["harmonic", "field", "law", "of", "entropy", "谐振频率", "振动", "resonance", "stationär", "x　y", "gravitational capacitance", "fields", "laws", "entropies"]
    out = {" ".join(["energy", *r.choices(words, k=r.randrange(5))]) for _ in range(n)} | {f"energy {k:04d}" for k in range(n)}
    out |= {"".join(r.sample("abcdefghijklmnopqrstuvwxyz0123456789谐振频率场能量", k)) + " energy" for k in range(2, 40) for _ in range(3)}
    out |= {t[:-1] for t in list(out)[: n // 2]} | {"energy", "ENERGY", "é", "ab energy", "energy energy"}
    return spark.createDataFrame([(k, t, t.lower().split(), k % 3 == 0) for k, t in enumerate(sorted(out))], "id bigint, content string, t array<string>, first boolean")


def test_alike_texts_against_all_pairs(spark):
    t = _texts(spark, 150).localCheckpoint()
    a, b = (t.select(F.col("id").alias(k), F.col("content").alias(c), F.col("t").alias(f"t{k}"), F.col("first").alias(f"f{k}")) for k, c in (("a", "x"), ("b", "y")))
    every = a.join(b, F.col("a") < F.col("b")).where(F.arrays_overlap("ta", "tb") & (F.col("fa") | F.col("fb"))).withColumn("s", sim.text_similarity(F.col("x"), F.col("y"), [], F.col("ta"), F.col("tb")))
    every = [(r["s"], tuple(sorted((r["x"], r["y"])))) for r in every.select("s", "x", "y").collect()]
    for least in (0.5, 0.7, 0.85, 1.0):
        pairs = alike.text_candidates(t, least)
        got = [tuple(r) for r in alike.alike_texts(pairs, t, least).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for s, p in every if s >= least}
        if least == 0.85:
            assert pairs.count() < len(every) / 5  # a common word alone makes no pair


def test_set_keys():
    r = random.Random(3)
    for share in (0.3, 0.739, 0.85):
        sets = [r.sample(range(9 if n < 5 else n + 2), n) for n in [*range(1, 15)] * 4]
        keys = [set(alike.set_keys(sorted(s), share)) for s in sets]
        for (s, ks), (u, ku) in combinations(zip(sets, keys), 2):
            if len({*s} & {*u}) >= share * len({*s} | {*u}):
                assert ks & ku
    assert not list(alike.set_keys([], 0.5))


def test_merging_does_not_pair_all_places_of_a_content(spark):
    """Pairs of places were tried, 40,000 squared: before, this took minutes."""
    kinds = "node_id string, doc_id bigint, node_type string, content string, weight double, aliases array<string>"
    nodes = spark.range(40_000).select(F.format_string("e%05d", "id").alias("node_id"), F.col("id").alias("doc_id"), F.lit("entity").alias("node_type"), F.lit("energy").alias("content"), F.lit(1.0).alias("weight"), F.lit(None).cast("array<string>").alias("aliases"))
    nodes = nodes.unionByName(spark.createDataFrame([("f0", 7, "entity", "energys", 0.5, None), ("a0", None, "entity", "energys!", 0.5, None)], kinds))
    edges = spark.createDataFrame([], "from_id string, to_id string, edge_type string, weight double, link_method string, ingested_at timestamp")
    merged = build.merge_concepts(nodes, edges, ["energy"])[2]
    assert merged.count() == 40_001 and [r[0] for r in merged.select("into").distinct().collect()] == ["a0"]


def test_relevant_documents_and_their_links(spark):
    """All pairs from a relevance on, and the same links as from all pairs, though few pairs are looked into."""
    r = random.Random(7)
    words = ["harmonic", "field", "law", "entropy", "resonance", "current", "谐振频率", "振动", "heat", "light"]
    rows = [(f"d{k}", k, "document", r.choice(["notes", "notes of heat", "谐振频率讲义", "Mechanik"]) + f"_{k % 40}.pdf") for k in range(120) if k % 11]
    rows += [(f"n{k:04d}", k % 120, "entity", "energy " + " ".join(r.choices(words, k=r.randrange(3)))) for k in range(500)]
    nodes = spark.createDataFrame(rows, "node_id string, doc_id bigint, node_type string, content string").localCheckpoint()
    src = spark.range(0, 120, 7).select(F.col("id").alias("doc_id"))
    every = {(x["doc_a"], x["doc_b"]): x["relevance"] for x in build.document_relevance(nodes, src, []).collect()}
    for least in (1.0, 0.9, 0.8):
        got = [(x["doc_a"], x["doc_b"], x["relevance"]) for x in build.document_relevance(nodes, src, [], least).collect()]
        assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2] for x in got} == {p: v for p, v in every.items() if round(v, 9) >= least}
    whole = [tuple(x) for x in build.cross_links(nodes, build.document_relevance(nodes, src, []), [], most=100_000).orderBy("order").collect()]
    for most in (20, 300):
        assert [tuple(x) for x in build.best_cross_links(nodes, src, [], most=most).orderBy("order").collect()] == whole[:most]
    assert len(whole) > 300
