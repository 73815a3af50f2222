"""Similarity of short texts and of vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import WS, term_key
from quillgraph.functions.tokens import dict_tokens


def _chars(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(c, WS, ""), ""), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(n > 0, 2 * F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def text_similarity(a: Column, b: Column, terms: list[str], ta: Column | None = None, tb: Column | None = None) -> Column:
    """1 if equal; 0.5 + 0.5 * shorter / longer if one holds the other; 0 if either has no tokens; else the best of
    token Jaccard, token Dice and character Jaccard. Null or empty: 0. ta and tb are the distinct tokens where the
    caller has them already: in a join they are made once a row, not once a pair."""
    ta = F.array_distinct(dict_tokens(a, terms)) if ta is None else ta
    tb = F.array_distinct(dict_tokens(b, terms)) if tb is None else tb
    la, lb = F.length(a), F.length(b)
    holds = (la >= 2) & (lb >= 2) & (a.contains(b) | b.contains(a))
    loose = F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.greatest(jaccard(ta, tb), dice(ta, tb), jaccard(_chars(a), _chars(b))))
    out = F.when(a == b, 1.0).when(holds, 0.5 + 0.5 * F.least(la, lb) / F.greatest(la, lb)).otherwise(loose)
    return F.when((F.coalesce(la, F.lit(0)) == 0) | (F.coalesce(lb, F.lit(0)) == 0), 0.0).otherwise(out)


def term_similarity(a: Column, b: Column) -> Column:
    """On term keys: equal 1, containment 0.95, else Jaccard of characters; an empty key: 0."""
    ka, kb = term_key(a), term_key(b)
    empty = (F.coalesce(F.length(ka), F.lit(0)) == 0) | (F.coalesce(F.length(kb), F.lit(0)) == 0)
    return F.when(empty, 0.0).when(ka == kb, 1.0).when(ka.contains(kb) | kb.contains(ka), 0.95).otherwise(jaccard(_chars(ka), _chars(kb)))


def common_run(a: Column, b: Column) -> Column:
    """Length of the longest common substring of two short strings, by the row-by-row recurrence."""
    ca, cb = F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.struct(F.transform(cb, lambda x: F.lit(0)).alias("row"), F.lit(0).alias("best"))

    def step(acc: Column, ch: Column) -> Column:
        row = F.transform(cb, lambda x, i: F.when(x == ch, F.when(i > 0, F.get(acc["row"], i - 1)).otherwise(F.lit(0)) + 1).otherwise(F.lit(0)))
        return F.struct(row.alias("row"), F.greatest(acc["best"], F.coalesce(F.array_max(row), F.lit(0))).alias("best"))

    return F.aggregate(ca, zero, step, lambda acc: acc["best"])


def label_similarity(a: Column, b: Column, terms: list[str]) -> Column:
    """For links across documents, on link forms: equal 1; containment 0.55 + 0.45 * shorter / longer; a common run of
    three or more 0.5 + 0.3 * run / longer, of two 0.25 + 0.3 / longer; at least the text similarity, at most 1."""
    la, lb = F.length(a), F.length(b)
    longer, run = F.greatest(la, lb), common_run(a, b)
    by_run = F.when(run >= 3, 0.5 + 0.3 * run / longer).when(run == 2, 0.25 + 0.15 * 2 / longer).otherwise(0.0)
    loose = F.when(a.contains(b) | b.contains(a), 0.55 + 0.45 * F.least(la, lb) / longer).otherwise(by_run)
    out = F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(loose, text_similarity(a, b, terms))))
    return F.when((F.coalesce(la, F.lit(0)) == 0) | (F.coalesce(lb, F.lit(0)) == 0), 0.0).otherwise(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors, within [-1, 1]; 0 if sizes differ or either is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n)))


def stub_embedding(c: Column, dim: int = 64) -> Column:
    """Unit vector without a model: code points / 65536 summed by position modulo dim; all zero for an empty text."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) / 65536.0)

    def sums(cs: Column) -> Column:
        def at(k: Column) -> Column:
            steps = F.when(F.size(cs) > k, F.sequence(k, F.size(cs) - 1, F.lit(dim))).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.get(cs, i))

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)

    def unit(raw: Column) -> Column:
        norm = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)
        return F.transform(F.arrays_zip(raw.alias("x"), F.array_repeat(norm, dim).alias("n")), lambda p: F.when(p["n"] > 0, p["x"] / F.sqrt(p["n"])).otherwise(0.0))

    # one-element arrays name what is made once and used many times
    return F.flatten(F.transform(F.transform(F.array(codes), sums), unit))
