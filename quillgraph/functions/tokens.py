"""Tokenizers and splitters as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import CJK, strip_marks, trim_ws, unicode_lower_trim

#: Terms a dictionary may have to be compiled into a pattern.
MAX_TERMS = 50_000
#: A string begins with an ideograph if it is not before the first and before the second of these.
CJK_FIRST, CJK_AFTER = "一", "龦"
SENTENCE_ENDS = "。！？.;；\n"


def dictionary(term_dict: DataFrame) -> list[str]:
    """Distinct terms, trimmed and in lower case, of at least two characters, in order; null and blank ones are dropped.

    The dictionary is configuration and travels to every task, so its size is checked.
    """
    t = term_dict.select(unicode_lower_trim(F.col("term")).alias("t")).where("length(t) >= 2").distinct().limit(MAX_TERMS + 1)
    terms = sorted(r[0] for r in t.collect())
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} dictionary terms")
    return terms


def trie_pattern(terms: list[str]) -> str:
    """One pattern that matches the longest term at a place, sharing prefixes so that a place costs one walk. Many arms
    are halved by the range of their first characters, so that a walk tries few of them."""
    root: dict = {}
    for t in terms:
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def quoted(ch: str) -> str:
        return re.sub(r"([.^$*+?{}\[\]\\|()#&~-])", r"\\\1", ch)

    def halved(arms: list[tuple[str, str]]) -> str:
        if len(arms) <= 4:
            return "|".join(a for _, a in arms)
        half = len(arms) // 2
        return "|".join(f"(?=[{quoted(x[0][0])}-{quoted(x[-1][0])}])(?:{halved(x)})" for x in (arms[:half], arms[half:]))

    def emit(node: dict) -> str:
        arms = [(ch, quoted(ch) + emit(node[ch])) for ch in sorted(node) if ch]
        if not arms:
            return ""
        body = arms[0][1] if len(arms) == 1 and "" not in node else "(?:" + halved(arms) + ")"
        return body + ("?" if "" in node else "")

    return emit(root)


def grams(c: Column, n: int) -> Column:
    """All character n-grams of a string, in order. Characters are split once: a substring at every place
    would walk the string from its start each time."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    empty = F.array().cast("array<string>")
    of = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat(*[F.get(a, i + k) for k in range(n)]))
    # the one-element array names the split string, so it is split once and not at every place
    return F.when(F.length(c) >= n, F.flatten(F.transform(F.array(chars), of))).otherwise(empty)


def cjk_grams(c: Column, n: int) -> Column:
    """grams() of a string of ideographs: a look ahead at every place."""
    return F.regexp_extract_all(c, F.lit(f"(?=({CJK}{{{n}}}))"), 1)


def dict_matches(c: Column, terms: list[str]) -> Column:
    """What dict_tokens() finds, before runs are taken apart: terms, runs of ideographs, Latin or digit runs."""
    return F.regexp_extract_all(strip_marks(c), F.lit(f"({_pattern(terms)})"), 1)


def _pattern(terms: list[str]) -> str:
    return (f"{trie_pattern(terms)}|" if terms else "") + f"{CJK}+|[a-zA-Z0-9]+"


def sentence_matches(c: Column, terms: list[str]) -> Column:
    """dict_matches() of all that lies between SENTENCE_ENDS, and these as matches between. Terms and marks that hold such an
    end are none in a sentence."""
    inner = [t for t in terms if not set(t) & set(SENTENCE_ENDS)]
    marks = F.regexp_replace(c, r"\[fs\d+\]|\[bookmark:L\d+\]", "")
    return F.regexp_extract_all(marks, F.lit(f"({_pattern(inner)}|[{SENTENCE_ENDS}])"), 1)


def dict_tokens(c: Column, terms: list[str]) -> Column:
    """Longest dictionary term first; else a run of ideographs, of four or more as bigrams and dropped if shorter;
    else a Latin or digit run of at least two in lower case. A term inside a run is not seen once the run has begun."""
    found = dict_matches(c, terms)

    def of(m: Column) -> Column:
        # comparisons and a hash set: a pattern or nested lambdas here would cost more than finding the matches
        empty, run = F.array().cast("array<string>"), (m >= CJK_FIRST) & (m < CJK_AFTER)
        return F.when(m.isin(terms), F.array(m)).when(run, F.when(F.length(m) >= 4, cjk_grams(m, 2)).otherwise(empty)).when(F.length(m) > 1, F.array(F.lower(m))).otherwise(empty)

    return F.flatten(F.transform(found, of))


def ngram_tokens(c: Column) -> Column:
    """All ideographs of the text as one string in 2-, 3- and 4-grams, then Latin words of at least two, in lower case."""
    cjk = F.array_join(F.regexp_extract_all(strip_marks(c), F.lit(f"({CJK}+)"), 1), "")
    latin = F.filter(F.regexp_extract_all(strip_marks(c), F.lit("([a-zA-Z][a-zA-Z0-9]*)"), 1), lambda w: F.length(w) >= 2)
    return F.concat(cjk_grams(cjk, 2), cjk_grams(cjk, 3), cjk_grams(cjk, 4), F.transform(latin, F.lower))


def cjk_terms(c: Column) -> Column:
    """Grams of 2 to 6 of every run of ideographs, and runs longer than that whole."""
    runs = F.regexp_extract_all(c, F.lit(f"({CJK}{{2,}})"), 1)
    longer = F.filter(runs, lambda r: F.length(r) > 6)

    def all_of(n: int) -> Column:
        return F.flatten(F.transform(runs, lambda r: grams(r, n)))

    return F.concat(*[all_of(n) for n in range(2, 7)], longer)


def words(c: Column) -> Column:
    """Latin or digit runs of at least two in lower case, and bigrams of ideographs: tokens without a dictionary."""
    return dict_tokens(c, [])


def sentences(c: Column, least: int = 8) -> Column:
    return F.filter(F.transform(F.split(c, f"[{SENTENCE_ENDS}]+"), trim_ws), lambda s: F.length(s) >= least)


def clauses(c: Column) -> Column:
    return F.split(c, "[。；;]")


def paragraphs(c: Column) -> Column:
    """Blocks of more than 30 characters between blank lines; with fewer than three of them, lines of more than 30;
    with none, the whole text."""
    def keep(p: str) -> Column:
        return F.filter(F.transform(F.split(c, p), trim_ws), lambda s: F.length(s) > 30)

    blocks, lines = keep(r"\n\s*\n+"), keep(r"\n+")
    some = F.when(F.size(blocks) >= 3, blocks).otherwise(lines)
    whole = F.when(trim_ws(c) != "", F.array(trim_ws(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(some) > 0, some).otherwise(whole)


def packed_paragraphs(c: Column, longest: int = 500) -> Column:
    """paragraphs() with longer ones packed again from their sentences, each closed by a full stop."""
    def pack(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

        def add(acc: Column, s: Column) -> Column:
            fits = F.length(acc["cur"]) + F.length(s) <= longest
            closed = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
            piece = F.concat(s, F.lit("。"))
            return F.struct(F.when(fits, acc["out"]).otherwise(closed).alias("out"), F.when(fits, F.concat(acc["cur"], piece)).otherwise(piece).alias("cur"))

        def end(acc: Column) -> Column:
            return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

        return F.when(F.length(p) <= longest, F.array(p)).otherwise(F.aggregate(sentences(p), start, add, end))

    return F.flatten(F.transform(paragraphs(c), pack))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each starting `size - overlap` after the one before."""
    at = F.sequence(F.lit(0), F.greatest(F.length(c) - 1 - overlap, F.lit(0)), F.lit(max(1, size - overlap)))
    return F.transform(at, lambda i: F.substring(c, i + 1, F.lit(size)))

