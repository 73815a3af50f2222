"""Queries over tokenizers, splitters and term statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import tokens as tk
from quillgraph.operators import terms as tm
from quillgraph.plans.q_text import STOP
from quillgraph.plans.shared import latest, materialize, table


def _docs(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", "text", "lang")


def _terms(spark, d):
    return tk.dictionary(table(spark, d, "term_dict"))


def _counts(spark, d):
    return tm.token_counts(_docs(spark, d), "doc_id", "text", _terms(spark, d))


def tokens_dict(spark, d):
    return _counts(spark, d).select("doc_id", "token", "tf")


def ngram_counts(spark, d):
    t = _docs(spark, d).select("doc_id", F.explode(tk.ngram_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return t.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tk.sentences(F.col("text"))).alias("ord", "sentence"))


def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tk.paragraphs(F.col("text"))).alias("ord", "p")).select("doc_id", "ord", F.length("p").alias("n"), F.md5("p").alias("digest"))


def packed_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tk.packed_paragraphs(F.col("text"))).alias("ord", "p")).select("doc_id", "ord", F.length("p").alias("n"))


def clauses(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tk.clauses(F.col("text"))).alias("ord", "clause")).where("length(clause) >= 10")


def chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tk.chunks(F.col("text"), 1000, 120)).alias("ord", "c")).select("doc_id", "ord", F.length("c").alias("n"), F.md5("c").alias("digest"))


def idf(spark, d):
    return tm.idf(_counts(spark, d), _docs(spark, d).count()).select("token", "df", F.round("idf", 6).alias("idf"))


def keywords(spark, d):
    k = tm.keywords(_counts(spark, d), "doc_id", _terms(spark, d), STOP)
    return k.select("doc_id", "rank", "word", F.round("score", 6).alias("score"), "is_term")


def keywords_idf(spark, d):
    c = materialize(_counts(spark, d), "token-counts")  # tokenised once for both uses
    k = tm.keywords(c, "doc_id", _terms(spark, d), STOP, 12, tm.idf(c, _docs(spark, d).count()))
    return k.select("doc_id", "rank", "word", F.round("score", 6).alias("score"), "is_term")


def _by_lang(spark, d):
    """One row a sentence, keyed by language: grams do not cross sentences of different documents."""
    return _docs(spark, d).select(F.coalesce("lang", F.lit("-")).alias("lang"), F.explode(tk.sentences(F.col("text"))).alias("text"))


def pmi(spark, d):
    return tm.pmi(_by_lang(spark, d), "lang", "text").select("lang", "word", "n", F.round("pmi", 6).alias("pmi"))


def _candidates(spark, d):
    return _by_lang(spark, d).select("lang", F.explode(tk.ngram_tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def substring_suppression(spark, d):
    return tm.suppressed(_candidates(spark, d), "lang")


def _sentence_tokens(spark, d):
    """One row a sentence, with the array of its tokens."""
    return _docs(spark, d).select(F.explode(tk.sentences(F.col("text"))).alias("s")).select(tk.dict_tokens(F.col("s"), _terms(spark, d)).alias("tokens"))


def window_pairs(spark, d):
    return tm.window_pairs(_sentence_tokens(spark, d), "tokens")


def textrank(spark, d):
    return tm.textrank(window_pairs(spark, d)).select("word", F.round("score", 6).alias("score"))


def best_terms(spark, d):
    n = latest(table(spark, d, "graph_nodes").select("node_id", "keyword", "weight", "ingested_at"), "node_id", "ingested_at").where("keyword is not null and weight is not null")
    return tm.best_terms(n, "keyword", "weight", "node_id").select("term_key", "keyword", "weight", "node_id")


def specificity(spark, d):
    n = latest(table(spark, d, "graph_nodes").select("node_id", "weight", "ingested_at"), "node_id", "ingested_at")
    s, generic = tm.specificity(F.round(F.col("weight") * 3).cast("int"))
    return n.where("weight is not null").select("node_id", s.alias("specificity"), generic.alias("is_generic"))


def question_lines(spark, d):
    """Numbered questions and answers of every text, each line with its running question number."""
    from pyspark.sql import Window

    line = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(tx.trim_ws(F.col("line")) != "")
    begins = F.col("line").rlike(r"^\s*(?:[0-9]{1,3}\s*[.、．]|[(（][0-9]{1,3}[)）]|[一二三四五六七八九十]+、|Q:|问[：:])").cast("int")
    line = line.withColumn("question", F.sum(begins).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).where("question > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: tx.trim_ws(s["line"])), "\n")
    return line.groupBy("doc_id", "question").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), text.alias("body")).where("length(body) >= 15").select("doc_id", "question", "line_no", "n_lines", F.md5("body").alias("digest"))


QUERIES = {f"q_{f.__name__}": f for f in (tokens_dict, ngram_counts, sentences, paragraphs, packed_paragraphs, clauses, chunks, idf, keywords, keywords_idf, pmi, substring_suppression, window_pairs, textrank, best_terms, specificity, question_lines)}

# -- SQL ---------------------------------------------------------------------------------------------
_WS = tx.WS


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_STOP = ", ".join(f"'{w}'" for w in STOP)
_DICT = f"dict as (select distinct {_trim('lower(term)')} t from term_dict where term is not null), dict2 as (select t from dict where length(t) >= 2), pat as (select '(' || string_agg(regexp_escape(t), '|' order by length(t) desc, t) || '|[一-龥]+|[a-zA-Z0-9]+)' p, list(t) ts from dict2)"


def _dict_tokens(rel: str, text: str, keep: str) -> str:
    """SQL: keep, token, pos of the dictionary tokenizer over rel."""
    return rf"""(select {keep}, token, row_number() over (partition by {keep} order by i, j) - 1 pos from (select {keep}, i, unnest(toks) token, unnest(range(len(toks))) j from (select {keep}, i,
 case when t is not null then [m] when regexp_matches(m, '^[一-龥]') then case when length(m) >= 4 then list_transform(range(1, length(m)), lambda i: substring(m, cast(i as int), 2)) else []::varchar[] end when length(m) > 1 then [lower(m)] else []::varchar[] end toks
 from (select {keep}, unnest(ms) m, unnest(range(len(ms))) i from (select {keep}, regexp_extract_all({tx_strip(text)}, p) ms from {rel}, pat)) left join dict2 on m = t)))"""


def tx_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\[fs\d+(?:\.\d+)?\]|\[bookmark:L\d+\]', '', 'g')"


_CNT = f"with {_DICT}, docs as (select doc_id, text, lang from documents where text <> ''), tok as {_dict_tokens('docs', 'text', 'doc_id')}, cnt as (select doc_id, token, count(*) tf, min(pos) first_pos from tok group by 1, 2), idf as (select token, count(*) df, ln((select count(*) from docs) / count(*)) idf from cnt group by 1)"
_KW = r"""kept as (select cnt.*, token in (select t from dict2) is_term from cnt), flt as (select * from kept where is_term or (length(token) >= 2 and token not in (""" + _STOP + r""") and not regexp_matches(token, '^[0-9.\-+eE×x⁻]+$|^[0-9]+[a-zA-Z]{1,2}$') and not (length(token) = 2 and regexp_matches(token, '[一-龥]'))))"""
_SENT = rf"list_filter(list_transform(string_split_regex(text, '[。！？.;；\n]+'), lambda s: {_trim('s')}), lambda s: length(s) >= 8)"


def _ngrams(rel: str, keep: str) -> str:
    """SQL: keep, word of the n-gram tokenizer over rel."""
    return rf"""(with u as (select {keep}, row_number() over () u, {tx_strip('text')} x from {rel}), ch as (select {keep}, u, unnest(c) ch, unnest(range(len(c))) i from (select {keep}, u, regexp_extract_all(x, '[一-龥]') c from u)),
w as (select {keep}, ch a, lead(ch, 1) over o b, lead(ch, 2) over o c, lead(ch, 3) over o d from ch window o as (partition by u order by i))
select {keep}, a || b word from w where b is not null union all select {keep}, a || b || c from w where c is not null union all select {keep}, a || b || c || d from w where d is not null
union all select {keep}, lower(l) from (select {keep}, unnest(regexp_extract_all(x, '[a-zA-Z][a-zA-Z0-9]*')) l from u) where length(l) >= 2)"""


_LANG = f"docs as (select doc_id, text, coalesce(lang, '-') lang from documents where text <> ''), sl as (select lang, unnest({_SENT}) text from docs)"
_BEGIN = r"^\s*(?:[0-9]{1,3}\s*[.、．]|[(（][0-9]{1,3}[)）]|[一二三四五六七八九十]+、|Q:|问[：:])"
_WP = f"with {_DICT}, docs as (select doc_id, text from documents where text <> ''), st as (select doc_id || '/' || i unit, s[i + 1] s from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, {_SENT} s from docs))), tok as {_dict_tokens('st', 's', 'unit')}, wp as (select a.token a, b.token b, count(*) n from tok a join tok b on a.unit = b.unit and b.pos - a.pos between -4 and 4 and a.pos <> b.pos group by 1, 2)"


def _textrank_sql(rounds: int = 30) -> str:
    steps = "".join(f", s{k} as materialized (select lk.a word, 0.15 + 0.85 * sum(score * share) score from lk join s{k - 1} on lk.b = s{k - 1}.word group by 1)" for k in range(1, rounds + 1))
    return _WP + ", tot as (select a, sum(n) total from wp group by 1), lk as materialized (select wp.a, wp.b, n / total share from wp join tot on wp.b = tot.a), s0 as (select distinct a word, 1.0::double score from lk)" + steps + f" select word, round(score / (select max(score) from s{rounds}), 6) score from s{rounds}"


ORACLES = {
    "q_tokens_dict": _CNT + " select doc_id, token, tf from cnt",
    "q_ngram_counts": f"with docs as (select doc_id, text from documents where text <> ''), g as {_ngrams('docs', 'doc_id')}, c as (select doc_id, word, count(*) n from g group by 1, 2) select word token, cast(sum(n) as bigint) n, count(*) n_docs from c group by 1",
    "q_sentences": f"select doc_id, i ord, s[i + 1] sentence from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, {_SENT} s from documents where text <> ''))",
    "q_paragraphs": rf"""with p as (select doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda s: {_trim('s')}), lambda s: length(s) > 30) b, list_filter(list_transform(string_split_regex(text, '\n+'), lambda s: {_trim('s')}), lambda s: length(s) > 30) l from documents where text <> ''),
q as (select doc_id, case when len(case when len(b) >= 3 then b else l end) > 0 then case when len(b) >= 3 then b else l end when {_trim('text')} <> '' then [{_trim('text')}] else [] end s from p)
select doc_id, i ord, length(s[i + 1]) n, md5(s[i + 1]) digest from (select doc_id, s, unnest(range(len(s))) i from q)""",
    "q_clauses": "select doc_id, ord, clause from (select doc_id, i ord, s[i + 1] clause from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, string_split_regex(text, '[。；;]') s from documents where text <> ''))) where length(clause) >= 10",
    "q_chunks": "select doc_id, i ord, length(c) n, md5(c) digest from (select doc_id, i, substring(text, cast(i * 880 + 1 as int), 1000) c from (select doc_id, text, unnest(range(0, cast(greatest(length(text) - 121, 0) // 880 + 1 as int))) i from documents where text <> ''))",
    "q_idf": _CNT + " select token, df, round(idf, 6) idf from idf",
    "q_keywords": _CNT + ", " + _KW + ", r as (select *, tf * case when is_term then 3.0 else 1.0 end::double score from flt), k as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, first_pos) rank from r) select doc_id, rank, token word, round(score, 6) score, is_term from k where rank <= 15",
    "q_keywords_idf": _CNT + ", " + _KW + ", r as (select flt.*, tf * case when is_term then 3.0 else 1.0 end::double * case when idf = 0 then 1.0 else idf end score from flt join idf using (token)), k as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, first_pos) rank from r) select doc_id, rank, token word, round(score, 6) score, is_term from k where rank <= 12",
    "q_pmi": f"with {_LANG}, g as (select * from {_ngrams('sl', 'lang')} where length(word) in (2, 3)), tok as (select lang, word, count(*) n from g group by 1, 2), tot as (select lang, length(word) len, sum(n) total from tok group by 1, 2), ch as (select lang, ch, count(*) c from (select lang, unnest(regexp_extract_all(text, '[一-龥]')) ch from sl) group by 1, 2), sz as (select lang, sum(c) chars from ch group by 1), w as (select tok.lang, word, n, total, coalesce(chars, 1) chars, unnest(regexp_extract_all(word, '.')) ch from tok join tot on tok.lang = tot.lang and length(word) = len left join sz on tok.lang = sz.lang), v as (select w.lang, word, n, total, sum(ln(coalesce(c, 1) / chars)) logs from w left join ch on w.lang = ch.lang and w.ch = ch.ch group by 1, 2, 3, 4) select lang, word, n, round(ln((n + 0.1::double) / (total * 1.1::double)) - logs, 6) pmi from v",
    "q_substring_suppression": rf"""with {_LANG}, gr as (select lang, cs, i from (select lang, cs, unnest(range(1, len(cs) + 1)) i from (select lang, regexp_extract_all({tx_strip('text')}, '[一-龥]') cs from sl))),
g as (select lang, array_to_string(cs[i:i + k - 1], '') word from gr, (select unnest([2, 3, 4]) k) where i + k - 1 <= len(cs) union all select lang, lower(l) from (select lang, unnest(regexp_extract_all({tx_strip('text')}, '[a-zA-Z][a-zA-Z0-9]*')) l from sl) where length(l) between 2 and 4),
tok as materialized (select lang, word, count(*) n from g group by 1, 2),
sub as (select lang, word, n, unnest(list_concat(list_transform(range(1, length(word)), lambda i: substring(word, cast(i as int), 2)), list_transform(range(1, greatest(length(word) - 1, 1)), lambda i: substring(word, cast(i as int), 3)))) part from tok),
m as materialized (select lang, part, max(n) n from sub where part <> word group by 1, 2) select tok.lang, word from tok join m on tok.lang = m.lang and word = part where m.n >= tok.n""",
    "q_window_pairs": _WP + " select a, b, n from wp",
    "q_textrank": _textrank_sql(),
    "q_best_terms": rf"""with v as (select *, row_number() over (partition by node_id order by ingested_at desc, keyword desc nulls last, weight desc nulls last) rn from graph_nodes where node_id is not null), n as (select node_id, keyword, weight, regexp_replace(lower(keyword), '[，,、。.?？！!\"''“”‘’\[\]{{}}()（）\-\\/]|{_WS}', '', 'g') term_key from v where rn = 1 and keyword is not null and weight is not null), r as (select *, row_number() over (partition by term_key order by weight desc, node_id) k from n where term_key <> '') select term_key, keyword, weight, node_id from r where k = 1""",
    "q_specificity": "with v as (select *, row_number() over (partition by node_id order by ingested_at desc, weight desc nulls last) rn from graph_nodes where node_id is not null), s as (select node_id, least(greatest(cast(round(weight * 3) as int), 1), 10) specificity from v where rn = 1 and weight is not null) select node_id, specificity, specificity <= 4 is_generic from s",
    "q_question_lines": rf"""with l as (select doc_id, s[i + 1] line, i line_no from (select doc_id, s, unnest(range(len(s))) i from (select doc_id, string_split(text, chr(10)) s from documents where text <> ''))), k as (select *, {_trim('line')} t from l), q as (select *, sum(cast(regexp_matches(line, '{_BEGIN}') as int)) over (partition by doc_id order by line_no) question from k where t <> ''), g as (select doc_id, cast(question as bigint) question, cast(min(line_no) as int) line_no, count(*) n_lines, string_agg(t, chr(10) order by line_no) body from q where question > 0 group by 1, 2) select doc_id, question, line_no, n_lines, md5(body) digest from g where length(body) >= 15""",
}
