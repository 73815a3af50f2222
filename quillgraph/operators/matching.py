"""TF-IDF, vector and hybrid matching, full-text search and candidate filters."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import similarity as sim
from quillgraph.functions import tokens as tk
from quillgraph.functions.text import pages, trim_ws
from quillgraph.operators.nearest import most_shared, nearest
from quillgraph.plans.shared import materialize

WEIGHTS = {"keyword": 0.2, "tfidf": 0.3, "semantic": 0.3, "graph": 0.2}


def normalize_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Missing layers weigh 0; weights that do not add up to 1 are scaled; none or an empty dict means the defaults."""
    if not weights:
        return dict(WEIGHTS)
    w = {k: float(weights.get(k, 0.0)) for k in WEIGHTS}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 and abs(total - 1) > 0.001 else w


def postings(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, token, tf (count / tokens of the document), n_tokens, n_distinct."""
    t = docs.select(key, F.explode(tk.dict_tokens(F.col(text), terms)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    return t.select(key, "token", "c", F.sum("c").over(w).alias("n_tokens"), F.count("*").over(w).alias("n_distinct")).withColumn("tf", F.col("c") / F.col("n_tokens"))


def tfidf(post: DataFrame, key: str, n_docs: int) -> DataFrame:
    """key, token, w with idf = ln((N + 1) / (df + 1)) + 1."""
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    return post.join(df, "token").select(key, "token", (F.col("tf") * (F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def sparse_cosine(queries: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """q, d, score of every query and document sharing a token: an equi-join on tokens, reduced by pair."""
    nq = queries.groupBy(q).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nq"))
    nd = docs.groupBy(d).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nd"))
    both = queries.select(q, "token", F.col("w").alias("wq")).join(docs.select(d, "token", F.col("w").alias("wd")), "token").groupBy(q, d).agg(F.sum(F.col("wq") * F.col("wd")).alias("s"))
    return both.join(nq, q).join(nd, d).select(q, d, (F.col("s") / (F.col("nq") * F.col("nd"))).alias("score"))


def token_overlap(queries: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """q, d, score: Jaccard of distinct tokens; both sides as postings()."""
    a = queries.select(q, "token", F.col("n_distinct").alias("na"))
    b = docs.select(d, "token", F.col("n_distinct").alias("nb"))
    j = a.join(b, "token").groupBy(q, d, "na", "nb").agg(F.count("*").alias("both"))
    return j.select(q, d, (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("score"))


def top_k(df: DataFrame, by: str, k: int, score: str = "score", *ties: str) -> DataFrame:
    """The k best rows of every group, ties in the given order; adds rank."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block_rows: int = 1000) -> DataFrame:
    """query_id, key, score, rank: the k nearest of all rows by cosine for every query, exactly.

    Queries are taken in blocks of about `block_rows`, one pass each; a block travels to every task as one bounded array,
    is scored against the rows where they lie, and leaves k rows per query.
    """
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    q = queries.select(F.col(key).alias("query_id"), F.col(vec).alias("q"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    v = vectors.select(key, F.col(vec).alias("v"))
    done = None
    for b in range(blocks):  # one bounded array at a time; its rows are written before the next is sent
        packed = q.where(F.col("block") == b).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        scored = v.join(F.broadcast(packed)).select(key, "v", F.explode("qs").alias("s"))
        best = top_k(scored.select(F.col("s.query_id").alias("query_id"), key, sim.cosine(F.col("s.q"), F.col("v")).alias("score")), "query_id", k, "score", key)
        best = best if blocks == 1 else materialize(best, "vector-block")
        done = best if done is None else done.unionByName(best)
    return done


def upsert_vectors(store: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of new replace rows of the same key; of repeated keys in new the last in `ord` wins."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).where("_r = 1").drop("_r", "ord")
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def hybrid(docs: DataFrame, queries: DataFrame, key: str, text: str, terms: list[str], weights: dict[str, float] | None = None, k: int = 10, graph: DataFrame | None = None) -> DataFrame:
    """query_id, key, score and its layers: keyword overlap, TF-IDF cosine and embedding cosine of every query
    (key, text) with every document sharing a token, plus a given graph layer (query_id, key, score)."""
    return nearest(docs, queries, key, text, terms, normalize_weights(weights), k, graph)


def find_all(haystack: Column, needle: str) -> Column:
    """Start positions (from 0) of all occurrences, overlapping ones too, ignoring case."""
    # split before every occurrence: every part but the first begins at a hit
    n, low = needle.lower(), F.lower(haystack)
    parts = F.split(low, "(?=" + "".join(f"\\x{{{ord(ch):X}}}" for ch in n) + ")")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    inner = F.slice(ends, 2, F.size(parts) - 1)
    return F.when(low.startswith(n), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def _answers(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come by document, its questions before its sentences; one document is held, and only if it has questions."""
    names = ["doc_id", "question", "ord", "sim", "rank"]

    def matched(doc: int, asked: list, said: list) -> list[tuple]:
        df = Counter(g for _, c in said for g in c)
        n, out, held = len(said) + 1.0, [], defaultdict(list)
        idf = {g: math.log(n / (x + 1)) + 1 for g, x in df.items()}
        none = math.log(n / 1.5) + 1
        norm = []
        for at, (_, c) in enumerate(said):
            norm.append(math.sqrt(sum((x * idf[g]) ** 2 for g, x in c.items())))
            for g, x in c.items():
                held[g].append((at, x * idf[g]))
        for question, c in asked:
            w, dot = {g: x * idf.get(g, none) for g, x in c.items()}, defaultdict(float)
            for g, x in w.items():
                for at, v in held.get(g, ()):
                    dot[at] += x * v
            size = math.sqrt(sum(x * x for x in w.values()))
            sims = sorted((-round(s, 9), said[at][0], s) for at, s in ((at, x / (size * norm[at])) for at, x in dot.items()) if s > least)
            out += [(doc, question, o, s, r) for r, (_, o, s) in enumerate(sims[:k], 1)]
        return out

    doc, asked, said = None, [], []
    for b in batches:
        out: list[tuple] = []
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("grams")).to_numpy(zero_copy_only=False))]).tolist()
        grams = b.column("grams").flatten()
        for r, (d, kind, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "n")))):
            if d != doc:
                if asked and said:
                    out += matched(doc, asked, said)
                doc, asked, said = d, [], []
            if kind == 0 or asked:
                (said if kind else asked).append((n, Counter(grams[ends[r] : ends[r + 1]].to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()))], names)
    if asked and said:
        out = matched(doc, asked, said)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()))], names)


def question_sentences(questions: DataFrame, sentences: DataFrame, stop_words: list[str], k: int = 5, least: float = 0.05) -> DataFrame:
    """doc_id, question, ord, sim, rank: for every question (doc_id, question, text) the k nearest sentences (doc_id, ord, text)
    of its document above `least`, by the cosine of raw counts of grams and words times ln((N + 1) / (df + 1)) + 1 over the
    sentences of the document; what no sentence holds counts with ln((N + 1) / 1.5) + 1. Ties go to the earlier sentence.

    Only texts are shuffled, to their document; grams are made there and never written.
    """
    side = lambda df, kind, n: df.select("doc_id", F.lit(kind).alias("kind"), F.col(n).cast("int").alias("n"), "text")
    both = side(questions, 0, "question").unionByName(side(sentences, 1, "ord")).where("text is not null and doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "kind", "n")
    grams = F.filter(tk.ngram_tokens(F.col("text")), lambda g: (F.length(g) >= 2) & ~g.isin(stop_words))
    return both.select("doc_id", "kind", "n", grams.alias("grams")).mapInArrow(partial(_answers, k=k, least=least), "doc_id bigint, question int, ord int, sim double, rank int")


def section_matches(questions: DataFrame, sections: DataFrame, q: str, s: str, terms: list[str], top: int = 3) -> DataFrame:
    """q, s, text_sim, overlap, score, rank: for every question (q, text, words: map of keyword to score) the `top` sections
    (s, text, words) by 0.4 * text similarity + 0.6 * overlap of keywords, above 0.05, or with an overlap above 0.1.

    Compared are pairs that share a token; without one the similarity of tokens is 0 and that of characters does not count.
    """
    side = lambda df, key, n: df.select(F.col(key).alias(n), F.col("text").alias(n + "x"), F.col("words").alias(n + "w"), F.array_distinct(tk.dict_tokens(F.col("text"), terms)).alias(n + "t"))
    a, b = materialize(side(questions, q, "_a"), "question-side"), materialize(side(sections, s, "_b"), "section-side")
    near = a.select("_a", F.explode("_at").alias("t")).join(b.select("_b", F.explode("_bt").alias("t")), "t").select("_a", "_b").distinct()
    p = near.join(a, "_a").join(b, "_b")
    total = F.aggregate(F.map_values("_aw"), F.lit(0.0), lambda x, y: x + y)
    both = F.aggregate(F.map_keys("_aw"), F.lit(0.0), lambda x, w: x + F.when(F.map_contains_key("_bw", w), F.least(F.try_element_at("_aw", w), F.try_element_at("_bw", w))).otherwise(0.0))
    p = p.select(F.col("_a").alias(q), F.col("_b").alias(s), sim.text_similarity(F.col("_ax"), F.col("_bx"), terms, F.col("_at"), F.col("_bt")).alias("text_sim"), F.when(total > 0, both / total).otherwise(0.0).alias("overlap"))
    p = p.withColumn("score", 0.4 * F.col("text_sim") + 0.6 * F.col("overlap")).where("score > 0.05 or overlap > 0.1")
    return top_k(p, q, top, "score", s)


def first_positions(haystack: Column, needle: Column, most: int) -> Column:
    """Start positions (from 0) of the first `most` occurrences of a text that stands in a column, without overlaps; none
    for an empty one."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(haystack, F.when(needle != "", quoted).otherwise(F.lit("(?!)")), F.lit(most + 1))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        here = acc["at"] + F.length(p)
        return F.struct(F.concat(acc["out"], F.array(here)).alias("out"), (here + F.length(needle)).alias("at"))

    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda acc: acc["out"])


def full_text(documents: DataFrame, keyword: str, cap: int = 50, around: int = 40) -> DataFrame:
    """Hits of a keyword page by page: doc_id, page, match_index, snippet, score (hits on the page), rank.

    The first `cap` hits in document order are kept, best pages first. A blank keyword finds nothing;
    one of more than 500 characters is an error.
    """
    if len(keyword) > 500:
        raise ValueError("keyword too long")
    k = keyword.strip().lower()
    body = F.coalesce("raw_text", "text")
    page = documents.select("doc_id", F.posexplode(pages(body)).alias("page_ord", "p")).where(F.lower("p.text").contains(k) if k else F.lit(False))
    hits = page.select("doc_id", "page_ord", F.col("p.page").alias("page"), F.col("p.text").alias("t"), find_all(F.col("p.text"), k or "x").alias("at")).withColumn("score", F.size("at"))
    one = hits.select("doc_id", "page_ord", "page", "t", "score", F.explode("at").alias("match_index")).orderBy("doc_id", "page_ord", "match_index").limit(cap)
    lo, hi = F.greatest(F.col("match_index") - around, F.lit(0)), F.least(F.col("match_index") + len(k) + around, F.length("t"))
    snip = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring("t", lo + 1, hi - lo), F.when(hi < F.length("t"), "...").otherwise(""))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "page_ord", "match_index"))  # over at most `cap` rows
    return one.select("doc_id", "page", "match_index", snip.alias("snippet"), "score", rank.alias("rank"))


def node_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """node_id, content, score: 1 if the content holds the query, 0.8 if an alias does; best first, then by weight and id."""
    q = query.strip().lower()
    inside = F.lower("content").contains(q)
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q))
    s = F.when(inside, 1.0).when(alias, 0.8)
    return nodes.withColumn("score", s).where("score is not null").orderBy(F.desc("score"), F.desc_nulls_last("weight"), "node_id").limit(limit).select("node_id", "content", "score")


def index_tokens(c: Column, terms: list[str]) -> Column:
    """Distinct tokens and single ideographs: keys of the inverted index."""
    return F.array_distinct(F.concat(tk.dict_tokens(c, terms), F.regexp_extract_all(c, F.lit("([一-龥])"), 1)))


def index_candidates(queries: DataFrame, items: DataFrame, q: str, i: str, text: str, terms: list[str], k: int = 100) -> DataFrame:
    """q, i, shared: the k items of each query that share most index keys, ties by item."""
    side = lambda df, key: df.select(key, index_tokens(F.col(text), terms).alias("keys"))
    return most_shared(side(queries, q), side(items, i), q, i, k)


def auto_links(queries: DataFrame, items: DataFrame, q: str, i: str, text: str, terms: list[str], least: float = 0.25, most: int = 10, k: int = 100) -> DataFrame:
    """q, i, score, rank: of the index candidates those at least so similar, the `most` best of each query."""
    c = index_candidates(queries, items, q, i, text, terms, k)
    side = lambda df, k, n: df.select(k, F.col(text).alias(n), F.array_distinct(tk.dict_tokens(F.col(text), terms)).alias(n + "t"))
    c = c.join(side(queries, q, "_a"), q).join(side(items, i, "_b"), i)
    c = c.withColumn("score", sim.text_similarity(F.col("_a"), F.col("_b"), terms, F.col("_at"), F.col("_bt"))).where(F.col("score") >= least)
    return top_k(c, q, most, "score", i).select(q, i, "score", "rank")
