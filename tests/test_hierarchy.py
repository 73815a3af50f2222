import random

import pytest

from quillgraph.operators import hierarchy as hi


def brute(links):
    up = {}
    for c, p in set(links):
        up.setdefault(c, set()).add(p)
    state = {}

    def walk(x, seen):
        """(root, depth) by the longest way up, or None on or below a cycle."""
        if x in seen:
            return None
        if x not in up:
            return x, 0
        if x in state:
            return state[x]
        best = None
        for p in sorted(up[x]):
            r = walk(p, seen | {x})
            if r is None:
                return None
            cand = (-(r[1] + 1), r[0])
            best = cand if best is None or cand < best else best
        state[x] = (best[1], -best[0])
        return state[x]

    return {c: walk(c, frozenset()) or ("-", -1) for c in up}


def run(spark, links, per_task, paths=False):
    df = spark.createDataFrame(links, "child string, parent string")
    return {r["item_id"]: r for r in hi.hierarchy(df, paths, per_task).collect()}


def tree(n, seed, cycles=0, extra=0):
    rng = random.Random(seed)
    ids = [f"i{k:04d}" for k in range(n)]
    rng.shuffle(ids)
    links = [(ids[k], ids[rng.randrange(max(0, k - 4), k)]) for k in range(1, n) if rng.random() < 0.95]
    links += [(ids[rng.randrange(1, n // 2)], ids[rng.randrange(n // 2, n)]) for _ in range(cycles)]
    for _ in range(extra):
        k = rng.randrange(5, n)
        links.append((ids[k], ids[rng.randrange(0, k)]))
    return links


@pytest.mark.parametrize(("seed", "per_task", "cycles", "extra"), [(1, 10_000, 0, 0), (2, 40, 0, 0), (3, 40, 2, 0), (4, 40, 0, 6), (5, 10_000, 2, 6)])
def test_against_brute_force(spark, seed, per_task, cycles, extra):
    links = tree(250, seed, cycles, extra)
    got = run(spark, links, per_task, paths=True)
    assert {k: (r["root_id"], r["link_depth"]) for k, r in got.items()} == brute(links)
    parents = {}
    for c, p in links:
        parents.setdefault(c, set()).add(p)
    for k, r in got.items():
        if r["link_depth"] < 0:
            assert r["path"] is None
            continue
        path = r["path"]
        assert path[0] == r["root_id"] and path[-1] == k and len(path) == r["link_depth"] + 1
        assert all(a in parents[b] for a, b in zip(path, path[1:]))


def test_long_chain_squares(spark):
    """Shuffled ids leave no locality, so levels do not shrink and links are squared."""
    rng = random.Random(9)
    ids = [f"x{k:05d}" for k in range(400)]
    rng.shuffle(ids)
    links = list(zip(ids[1:], ids))
    ring = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d", "c1")]
    got = run(spark, links + ring, 20, paths=True)
    assert {k: r["link_depth"] for k, r in got.items() if k.startswith("x")} == {c: n + 1 for n, (c, _) in enumerate(links)}
    assert {got[k]["root_id"] for k in ("c1", "c2", "c3", "d")} == {"-"}
    assert got[ids[-1]]["path"] == ids


def test_own_parent_repeats_nulls_and_empty(spark):
    got = run(spark, [("a", "a"), ("b", "a"), ("c", "d"), ("c", "d"), (None, "d"), ("e", None)], 100)
    assert {k: (r["root_id"], r["link_depth"]) for k, r in got.items()} == {"a": ("-", -1), "b": ("-", -1), "c": ("d", 1)}
    assert run(spark, [], 100) == {}


def test_descendants(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "child string, parent string")
    got = {(r[0], r[1], r[2]) for r in hi.descendants(hi.hierarchy(df, True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_heading_links(spark):
    schema = "heading_id string, doc_id bigint, ord int, heading_level int, start_pos bigint, children array<string>, ingested_at timestamp_ntz, text string"
    from datetime import datetime as dt

    t1, t2 = dt(2024, 1, 1), dt(2024, 1, 2)
    rows = [
        ("h1", 1, 0, 1, 0, None, t1, "x"), ("h2", 1, 1, 2, 5, None, t1, "x"), ("h3", 1, 2, 2, 9, None, t1, "x"), ("h4", 1, 3, 3, 12, None, t1, "x"), ("h5", 1, 4, 1, 20, None, t1, "x"),
        ("k1", 2, 0, 1, 0, ["k2", "k2", "gone"], t1, "x"), ("k2", 2, 1, 2, 5, [], t1, "x"), ("k3", 2, 2, 2, 5, None, t1, "x"),
        ("k1", 2, 0, 1, 0, ["k3"], dt(2023, 1, 1), "older"), ("n", None, None, None, None, None, t2, None), (None, 1, 0, 1, 0, None, t1, "x"),
    ]
    got = {(r["child"], r["parent"]) for r in hi.heading_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("h2", "h1"), ("h3", "h1"), ("h4", "h3"), ("k2", "k1")}
    assert hi.heading_links(spark.createDataFrame([], schema)).count() == 0
