"""Term statistics and keyword extraction over sections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import tokens as tk
from quillgraph.functions.lists import flat
from quillgraph.functions.text import CJK, term_key
from quillgraph.plans.shared import materialize


def token_counts(sections: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, token, tf, first_pos of every section by the dictionary tokenizer."""
    t = sections.select(key, F.posexplode(tk.dict_tokens(F.col(text), terms)).alias("pos", "token"))
    return t.groupBy(key, "token").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def idf(counts: DataFrame, n_sections: int) -> DataFrame:
    """token, df, idf = ln(N / df) from token_counts()."""
    return counts.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n_sections)) / F.col("df")))


def plain_token(t: Column, stop_words: list[str]) -> Column:
    """Tokens other than dictionary terms that may be keywords."""
    return (F.length(t) >= 2) & ~t.isin(stop_words) & ~t.rlike(r"^[0-9.\-+eE×x⁻]+$|^[0-9]+[a-zA-Z]{1,2}$") & ~((F.length(t) == 2) & t.rlike(CJK))


def keywords(counts: DataFrame, key: str, terms: list[str], stop_words: list[str], top: int = 15, idfs: DataFrame | None = None) -> DataFrame:
    """The `top` keywords of every section: tf, times 3 for a dictionary term, times idf (an idf of 0 or none counts as 1).

    Kept are dictionary terms and other tokens of two or more characters that are no stop word, number or
    ideographic bigram. Ties go to the token seen first.
    """
    t = F.col("token")
    known = counts.sparkSession.createDataFrame([(x,) for x in terms], "token string")  # bounded by dictionary()
    c = counts.join(F.broadcast(known.withColumn("is_term", F.lit(True))), "token", "left").na.fill(False, ["is_term"])
    c = c.where(F.col("is_term") | plain_token(t, stop_words))
    score = F.col("tf") * F.when(F.col("is_term"), 3.0).otherwise(1.0)
    if idfs is not None:
        c = c.join(idfs.select("token", "idf"), "token", "left")
        score = score * F.when(F.coalesce("idf", F.lit(0.0)) == 0, 1.0).otherwise(F.col("idf"))
    ranked = c.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "first_pos")))
    return ranked.where(F.col("rank") <= top).select(key, "rank", F.col("token").alias("word"), "score", "is_term")


def pmi(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, n, pmi of the 2- and 3-character tokens of every text.

    ln of the smoothed share of the word among tokens of its length over the product of the shares of its
    characters among the ideographs of the text; a character that is none counts once.
    """
    tok = texts.select(key, F.explode(tk.ngram_tokens(F.col(text))).alias("word")).where("length(word) in (2, 3)").groupBy(key, "word").agg(F.count("*").alias("n"))
    total = tok.groupBy(key, F.length("word").alias("len")).agg(F.sum("n").alias("total"))
    chars = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({CJK})"), 1)).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias("c"))
    size = chars.groupBy(key).agg(F.sum("c").alias("chars"))
    w = tok.withColumn("len", F.length("word")).join(total, [key, "len"]).join(size, key, "left").select(key, "word", "n", "total", F.coalesce("chars", F.lit(1)).alias("chars"), F.explode(F.filter(F.split("word", ""), lambda x: x != "")).alias("ch"))
    w = w.join(chars, [key, "ch"], "left").groupBy(key, "word", "n", "total", "chars").agg(F.sum(F.log(F.coalesce("c", F.lit(1)) / F.col("chars"))).alias("logs"))
    return w.select(key, "word", "n", (F.log((F.col("n") + 0.1) / (F.col("total") * 1.1)) - F.col("logs")).alias("pmi"))


def suppressed(counts: DataFrame, key: str, word: str = "word", n: str = "n") -> DataFrame:
    """key, word of 2 to 4 characters inside a longer candidate of the same text that is at least as frequent.

    Every candidate offers its own shorter substrings, so the test is an equi-join.
    """
    c = counts.where(F.length(word).between(2, 4)).select(key, F.col(word).alias("word"), F.col(n).alias("n"))
    parts = c.select(key, "word", "n", F.explode(F.array_distinct(F.concat(tk.grams(F.col("word"), 2), tk.grams(F.col("word"), 3)))).alias("part")).where("part <> word").groupBy(key, "part").agg(F.max("n").alias("most"))
    return c.join(parts, [c[key] == parts[key], c["word"] == parts["part"], parts["most"] >= c["n"]], "left_semi").select(key, "word")


def _near(batches: Iterator[pa.RecordBatch], span: int, at_once: int = 700_000) -> Iterator[pa.RecordBatch]:
    """a <= b, n: pairs within the span, counted over about `at_once` tokens at a time."""

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        row, tok = flat(pa.concat_arrays(held))
        d = tok.dictionary_encode()
        order = pc.sort_indices(d.dictionary).to_numpy()  # by bytes, so a pair has the same order everywhere
        place = np.empty(len(order), "int64")
        place[order] = np.arange(len(order))
        code = place[d.indices.to_numpy()]
        size = max(1, len(order))
        key = [np.minimum(x, y)[same] * size + np.maximum(x, y)[same] for k in range(1, span + 1) for x, y, same in [(code[:-k], code[k:], row[:-k] == row[k:])]]
        key, n = np.unique(np.concatenate(key), return_counts=True)
        word = d.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([word.take(pa.array(key // size)), word.take(pa.array(key % size)), pa.array(n)], ["a", "b", "n"])

    held, some = [], 0
    for b in batches:
        held.append(b.column(0))
        some += len(b.column(0).flatten())
        if some >= at_once:
            yield counted(held)
            held, some = [], 0
    if some:
        yield counted(held)


def window_pairs(units: DataFrame, tokens: str, span: int = 4) -> DataFrame:
    """a, b, n: how often b stands within `span` tokens of a in the same unit; `tokens` is the array of a unit's tokens.

    Pairs are counted where their unit lies, without order; only counts are shuffled. A pair of different tokens then
    counts in both directions, one of the same token twice.
    """
    near = units.select(tokens).mapInArrow(partial(_near, span=span), "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    way = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", 2 * F.col("n")))).otherwise(F.array(way("a", "b", F.col("n")), way("b", "a", F.col("n"))))
    return near.select(F.explode(both).alias("p")).select("p.*")


def textrank(pairs: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """word, score: (1 - d) + d * sum of the neighbours' scores by their share of weight, divided by the greatest.

    pairs has (a, b, n), symmetric. Lineage is cut every ten rounds in the shared folder.
    """
    out = pairs.groupBy("a").agg(F.sum("n").alias("total"))
    links = materialize(pairs.join(out.select(F.col("a").alias("b"), "total"), "b").select("a", "b", (F.col("n") / F.col("total")).alias("share")), "textrank-links")
    score = links.select(F.col("a").alias("word")).distinct().withColumn("score", F.lit(1.0))
    for k in range(1, iterations + 1):
        s = links.join(score, links.b == score.word).groupBy("a").agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        score = s.select(F.col("a").alias("word"), (F.lit(1 - damping) + damping * F.col("s")).alias("score"))
        if k % 10 == 0:
            score = materialize(score, "textrank")
    most = score.agg(F.max("score").alias("most"))  # one row
    return score.join(F.broadcast(most)).select("word", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(F.col("score")).alias("score"))


def best_terms(terms: DataFrame, term: str, score: str, order: str) -> DataFrame:
    """One row per term_key: the best score, ties to the first in order."""
    w = Window.partitionBy("term_key").orderBy(F.desc(score), order)
    return terms.withColumn("term_key", term_key(F.col(term))).where("term_key <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_terms(terms: DataFrame, key: str, term: str, order: str) -> DataFrame:
    """One row per key and term, letter case aside: the first in order."""
    w = Window.partitionBy(key, F.lower(F.col(term))).orderBy(order)
    return terms.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def boosted(scores: DataFrame, key: str, suffixes: list[str]) -> DataFrame:
    """key, word, score of (key, word, score, pmi): times 1.5 with an ending of a discipline, 1.2 with three characters or
    more, 1.1 above a PMI of 2, and 0.7 if short, without such an ending and inside two longer words of the same text."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("word").endswith(s)
    sub = F.array_distinct(F.concat(tk.grams(F.col("word"), 2), tk.grams(F.col("word"), 3)))
    held = scores.select(key, "word", F.explode(sub).alias("part")).where("part <> word").groupBy(key, "part").agg(F.count("*").alias("inside"))
    j = scores.join(held.withColumnRenamed("part", "word"), [key, "word"], "left")
    low = (F.length("word") <= 3) & (F.coalesce("inside", F.lit(0)) >= 2) & ~ends
    by = F.when(ends, 1.5).otherwise(1.0) * F.when(F.length("word") >= 3, 1.2).otherwise(1.0) * F.when(F.col("pmi") > 2, 1.1).otherwise(1.0) * F.when(low, 0.7).otherwise(1.0)
    return j.select(key, "word", (F.col("score") * by).alias("score"))


def without_overlaps(words: list[tuple[str, float]], top: int, share: float = 0.5) -> list[tuple[str, float]]:
    """Down a ranking: a word inside a kept one that scores at least `share` as high for it is dropped; one that holds a kept word
    and scores `share` of it takes its place; at most `top` are kept."""
    kept: list[tuple[str, float]] = []
    for w, s in words:
        if any(w in k and w != k and ks >= share * s for k, ks in kept):
            continue
        at = next((n for n, (k, ks) in enumerate(kept) if k in w and k != w and s >= share * ks), None)
        if at is not None:
            kept[at] = (w, max(s, kept[at][1]))
        elif len(kept) < top:
            kept.append((w, s))
    return kept


def specificity(score: Column, threshold: int = 4) -> tuple[Column, Column]:
    """(score clamped to 1..10, generic)."""
    s = F.least(F.greatest(score, F.lit(1)), F.lit(10))
    return s, s <= threshold
