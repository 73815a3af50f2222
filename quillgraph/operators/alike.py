"""Pairs of sets and of short texts that are alike by a threshold: found by equal keys, not by each common member."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs are classed by the members the two must have in common at least: from, to, members that make a key.
CLASSES = ((1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 5, 4), (6, 7, 6), (8, 9, 8), (10, 18, 10), (19, 199, 3), (200, 1 << 40, 1))
BLANK = re.compile(r"[ \t\n\v\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]")  # as in text.WS
SLACK = 1e-6
#: A key's item; whether it leads; whether it is first; members hashed to bits; how many members may differ, in two such parts; hashed bits of what must be common.
KEYED = ["key", "id", "leads", "first", "bits", "differ", "common"]


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def set_keys(members: list[int], share: float) -> Iterator[int]:
    """Keys of a set in its fixed order: two sets with a Jaccard of `share` or more have a key in common.

    A set needs L = share * n common members at least; then the first l common ones of two sets are among the first n - L + l
    of each, and every l of these are a key. l goes by the class of the smaller need of the two, so a set has
    keys of each class in which it may have a partner.
    """
    n = len(members)
    least = max(1, ceil(share * n - SLACK))
    for k, (lo, hi, size) in enumerate(CLASSES):
        if n and lo <= least <= floor((hi + SLACK) / share):
            for c in combinations(members[: n - least + size], size):
                yield hash((k, *c))  # of numbers alone, so the same everywhere


def _bits(members: list[int]) -> int:
    out = 0
    for x in members:
        out |= 1 << ((x * 0x9E3779B97F4A7C15 >> 40) & 63)
    return out


def _keyed(batches: Iterator[pa.RecordBatch], by: list[tuple[str, str, float]], common: str) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}

    def code(s: str) -> int:
        if s not in known:
            if len(known) > 1_000_000:
                known.clear()
            known[s] = _hash(s)
        return known[s]

    for b in (x.slice(lo, 2000) for x in batches for lo in range(0, len(x), 2000)):
        ids, first = b.column("id").to_pylist(), b.column("first").to_pylist()
        key, of, leads, mine, bits, size, any_ = [], [], [], [], [], [], []
        shared = [_bits([code(x) for x in v or ()]) for v in b.column(common).to_pylist()]
        for k, (c, kind, share) in enumerate(by):
            for i, f, v, some_of in zip(ids, first, b.column(c).to_pylist(), shared):
                if not v or not some_of:
                    continue
                members: list[int] = []
                if kind == "inside":
                    n = len(v)
                    some = [_hash(v), *{_hash(v[at : at + m]) for m in range(max(1, ceil(share * n - SLACK)), n) for at in range(n - m + 1)}]
                    leads += [True, *[False] * (len(some) - 1)]
                else:
                    members = sorted(map(ord, set(BLANK.sub("", v))), reverse=True) if kind == "characters" else sorted({code(x) for x in v})
                    some = list(set_keys(members, share))
                    leads += [f] * len(some)
                key += [hash((k, x)) for x in some]
                for out, x in ((of, i), (mine, f), (bits, _bits(members)), (size, len(members) * (1 - share) / (1 + share)), (any_, some_of)):
                    out += [x] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(key, "int64"), pa.array(of, "int64"), pa.array(leads, "bool"), pa.array(mine, "bool"), pa.array(np.array(bits, "uint64").view("int64")), pa.array(size, "float64"), pa.array(np.array(any_, "uint64").view("int64"))], KEYED)


def _met(batches: Iterator[pa.RecordBatch], at_once: int = 500_000) -> Iterator[pa.RecordBatch]:
    """a < b: ids of one key, of which one leads and one (it or the other) is first, and whose bits don't tell that they differ too much."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    order = np.lexsort((~t.column("leads").to_numpy(), t.column("key").to_numpy()))
    key, ids, leads, first, bits, differ, common = (t.column(c).to_numpy()[order] for c in KEYED)
    bits = bits.view("uint64")  # of signed numbers the bits of the absolute value would be counted
    del held, t, order
    start, step, found, some = np.flatnonzero(leads), 1, [], 0
    while len(start):  # a row meets the one `step` rows on, until its key ends
        start = start[start + step < len(key)]
        start = start[key[start] == key[start + step]]
        for lo in range(0, len(start), at_once):
            i = start[lo : lo + at_once]
            j = i + step
            ok = (common[i] & common[j] != 0) & (np.bitwise_count(bits[i] ^ bits[j]) <= differ[i] + differ[j] + SLACK) & (first[i] | first[j]) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
            some += len(i)
            if some >= at_once:
                yield _distinct(found)
                found, some = [], 0
        step += 1
    yield _distinct(found)


def _distinct(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate(found, axis=1) if found else np.zeros((2, 0), "int64")
    p = p[:, np.lexsort((p[1], p[0]))]
    new = np.ones(p.shape[1], bool)
    new[1:] = (p[:, 1:] != p[:, :-1]).any(axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[0, new]), pa.array(p[1, new])], ["a", "b"])


def candidates(items: DataFrame, by: list[tuple[str, str, float]], common: str) -> DataFrame:
    """a < b: ids of all items (id bigint, first boolean, columns) that share a member of the list `common` and meet one of `by`
    (column, kind, share above 0), and of some others; of each pair one at least is `first`. The caller tests what is found.

    members: lists with a Jaccard of `share`; characters: texts, so by their characters without blanks; inside: one text
    is in the other and has `share` of its length.
    """
    cols = list(dict.fromkeys([common, *(c for c, _, _ in by)]))
    keys = items.select("id", "first", *cols).mapInArrow(partial(_keyed, by=by, common=common), "key bigint, id bigint, leads boolean, first boolean, bits bigint, differ double, common bigint")
    return keys.repartition("key").mapInArrow(_met, "a bigint, b bigint").distinct()


def text_rules(text: str, tokens: str, threshold: float) -> list[tuple[str, str, float]]:
    """What candidates() needs to find all texts with a similarity.text_similarity() of a threshold above 0.5."""
    t = threshold - SLACK
    return [(tokens, "members", t / (2 - t)), (text, "characters", t), (text, "inside", 2 * t - 1)]


def text_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """a < b: ids of all texts (id bigint, first, content, t: distinct tokens) that share a token and are similar by `threshold` or more, and
    of some others; of each pair one at least is `first`. A threshold of 0.5 or less compares all that share a token."""
    if threshold > 0.5:
        return candidates(texts, text_rules("content", "t", threshold), "t")
    tok = texts.select("id", "first", F.explode("t").alias("token"))
    two = tok.where("first").join(tok.select(F.col("id").alias("other"), "token"), "token").where("id <> other")
    return two.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[frozenset, frozenset]] = {}

    def sets(text: str, tokens: str) -> tuple[frozenset, frozenset]:
        if text not in known:
            if len(known) > 500_000:
                known.clear()
            known[text] = frozenset(tokens.split("\x01")), frozenset(BLANK.sub("", text))
        return known[text]

    for b in batches:
        keep = []
        for x, y, tx, ty in zip(*(b.column(c).to_pylist() for c in ("x", "y", "ta", "tb"))):
            (ta, ca), (tb, cb) = sets(x, tx), sets(y, ty)
            both = len(ta & tb)
            if x == y or not both:
                keep.append(x == y and both > 0)
            elif len(x) >= 2 and len(y) >= 2 and (x in y or y in x):
                keep.append(0.5 + 0.5 * min(len(x), len(y)) / max(len(x), len(y)) >= threshold)
            else:
                chars = len(ca & cb)
                keep.append(2 * both / (len(ta) + len(tb)) >= threshold or chars > 0 and chars / (len(ca) + len(cb) - chars) >= threshold)
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(keep, "bool"))


def alike_texts(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """content < other of the pairs (a, b: ids of texts) that share a token and have a similarity.text_similarity() of `threshold` or more."""
    t = texts.select("id", "content", F.array_join("t", "\x01").alias("t"))
    side = lambda k, c: t.select(F.col("id").alias(k), F.col("content").alias(c), F.col("t").alias(f"t{k}"))
    near = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", "ta", "tb").mapInArrow(partial(_similar, threshold=threshold), "x string, y string")
    return near.select(F.least("x", "y").alias("content"), F.greatest("x", "y").alias("other"))
