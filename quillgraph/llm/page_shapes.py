"""Keyword-stuffed and link-list pages by the shapes of their lines.

Every line is cut into sentence-size units, and each unit reduced to a shape: how many words it has, in steps,
how it begins (capital, lower case, digit, unspaced writing), what separates its parts, how many links it has
and how it ends. No list of words and no language is known. A unit has the shape of a sentence if it runs
through enough words without separators and ends in a mark; what is no sentence is a list, a link, a label or a
run of words. Lists, links and labels are not prose; a run of words counts as stuffed where its words repeat over
the page as they do not in prose. A page is flagged when shapes that are no sentences hold its greater part and
few such shapes hold most of that. A page is decided where it lies; only its profile is grouped with others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_URL = re.compile(r"(?:https?://|www\.)\S+|\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,12}/\S*", re.I)
_MARKER = re.compile(r"^\s*(?:\[\d+\]|\(?\d{1,3}[.)、:]|[-*•·–—])\s*")
_SEPARATOR = re.compile(r"\s[-–—/:]\s|>>|[,，、;；|+>»›•·→~]|\s{2,}")
_TAG = re.compile(r"#\w+|\b[A-Z]{2,}[0-9]{2,}\b|\b[0-9]+[.,][0-9]{2}\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Writing without spaces between words.
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿฀-໿က-႟ក-៿]")
_NUMBERISH = re.compile(r"[0-9a-f]{24,}|[-+]?\d[\d.,:/%]*", re.I)
_END = re.compile(r"[.!?。！？:：…]['\"”’」』）)]*\s*$")
_CODE = re.compile(r"[{}=();]\s*$|[{}]|\w\(|==|:=|=>|->|</?\w")
#: Kinds that are no sentences and no other honest content.
SPAM_KINDS = ("link", "list", "label", "stuffed")
#: Steps of the number of words in a shape.
_STEPS = (1, 2, 3, 4, 7, 15)


def _units(line: str) -> list[str]:
    for end in (". ", "! ", "? "):
        line = line.replace(end, end[0] + "\n")
    if not line.isascii():
        for end in "。！？":
            line = line.replace(end, end + "\n")
    return [u for u in map(str.strip, line.split("\n")) if u]


def _step(n: int) -> int:
    return max((s for s in _STEPS if s <= n), default=0)


def unit_shape(text: str) -> tuple[str, str, list[str]]:
    """(kind, shape, words) of one unit."""
    # the common case first: a sentence without anything that could make it another shape
    ended = bool(_END.search(text))
    links = len(_URL.findall(text)) if "/" in text or "www." in text else 0
    rest = _MARKER.sub("", _URL.sub(" ", text) if links else text)
    unspaced = len(_UNSPACED.findall(rest)) if not rest.isascii() else 0
    words = _WORD.findall(rest)
    letters = sum(map(len, words))
    parts = [p for p in _SEPARATOR.split(rest) if p and p.strip()]
    seps = _SEPARATOR.findall(rest) if len(parts) > 1 else []
    first = rest[:1]
    begin = "C" if first.isupper() else "d" if first.isdigit() else "i" if _UNSPACED.match(first) else "l" if first.isalpha() else "-"
    sep = Counter(s.strip() for s in seps).most_common(1)[0][0] if seps else ""
    numbers = sum(map(len, _NUMBERISH.findall(rest))) if any(c.isdigit() for c in rest) else 0
    tags = len(_TAG.findall(rest)) if "#" in rest or numbers else 0
    # the measure of a text in words; unspaced writing has about two characters to a word
    long = unspaced * 2 > letters
    measure = unspaced / 2 if long else len(words)
    each = measure / max(1, len(parts))
    sentence = ended and measure >= 3 and (each > 2.5 or len(parts) < 5 and (begin in "Ci" or each > 1.5)) and links * 6 <= measure and tags * 3 <= measure
    loose = not ended and long and unspaced >= 12 and each > 4 and sep in ("", "，", "、") and " " not in rest.strip() and links == 0
    if links and not sentence:
        kind = "link"
    elif tags >= 3 and not sentence and tags * 6 > measure:
        kind = "list"
    elif numbers > letters or letters == 0:
        kind = "numbers"
    elif sentence:
        kind = "sentence"
    elif not long and _CODE.search(rest) and sep in ("", ";", ",", "+", ">"):
        kind = "code"
    elif len(parts) >= 5 and each <= 5:
        kind = "list"
    elif loose or long and measure >= 12 and len(parts) < 3 and " " not in rest:
        kind = "words"
    elif measure >= 6:
        kind = "run"
    elif ended or sep in (",", "，", ";", "；"):
        kind = "words"  # a verse, an entry, a caption with marks in or after it
    else:
        kind = "label"
    return kind, f"{kind}/{_step(len(words))}/{begin}/{sep}/{min(links, 3)}/{'.' if ended else ''}", [w.lower() for w in words]


def _plainly_sentence(u: str) -> bool:
    """Has the shape of a sentence, seen without taking it apart: no link or tag, few separators, a begin and an end."""
    last = u[-1]
    if "/" in u or "#" in u or "|" in u or ">" in u:
        return False
    if last in "。！？":
        return len(u) >= 8 and u.count(" ") <= 3 and u.count("，") + u.count("、") + u.count("；") < 4 and bool(_UNSPACED.match(u[0]) or u[0].isdigit())
    return last in ".!?" and u[0].isupper() and u.count(" ") >= 3 and u.count(",") + u.count(";") + u.count("  ") <= 2 and " - " not in u


def _goes_round(text: str) -> bool:
    """The words of a text come again and again as they do in no prose: a dozen of them, or two dozen characters of
    unspaced writing, make up nearly all of it, each many times."""
    few, share, often = 12, 0.75, 6
    count = Counter(_unspaced(text)) if not text.isascii() else Counter()
    if sum(count.values()) * 2 > len(text) * 0.7:
        few, share, often = 24, 0.95, 6
    else:
        count = Counter()
        for chunk, n in Counter(text.lower().split()).items():
            if chunk.isalpha() or any(c.isdigit() for c in chunk):  # a number, a code or an address is one word
                count[chunk] += n
            else:
                for w in _WORD.findall(chunk):
                    count[w] += n
    total = sum(count.values())
    return total >= 24 and total >= often * len(count) and sum(c for _, c in count.most_common(few)) >= share * total


def _unspaced(text: str) -> dict[str, int]:
    return {c: n for c, n in Counter(text).items() if c > "\u0dff" and _UNSPACED.match(c)}


def page_profile(text: str) -> dict:
    """Characters by kind, those of non-sentence shapes by shape, and the number of units."""
    kinds: Counter = Counter()
    shapes: Counter = Counter()
    units: list[tuple[int, str, str, list[str]]] = []
    lines = [line for line in text.split("\n") if line.strip()]
    whole = _goes_round(text)
    for line in lines:
        parts = _units(line)
        if whole or len(line) > 100 and len(lines) > 1 and 3 * len(line) > len(text) and _goes_round(line):
            for u in parts:
                kinds["stuffed"] += len(u)
                shapes[f"stuffed/{_step(u.count(' ') + 1)}"] += len(u)
            units += [(len(u), "", "", []) for u in parts]
            continue
        found = [(len(u), "sentence", "", []) if _plainly_sentence(u) else (len(u), *unit_shape(u)) for u in parts]
        prose = any(u[1] == "sentence" for u in found)
        for n, kind, shape, words in found:
            if prose and (kind == "link" and not words or kind in ("label", "run")):
                kind = "sentence"  # the address after an entry, or the rest of a line of prose
            units.append((n, kind, shape, words))
    runs = Counter(w for _, k, _, ws in units if k == "run" for w in ws)
    total = sum(runs.values())
    # stuffing goes round in a handful of words; a word list or verse does not
    stuffed = sum(c for _, c in runs.most_common(12)) >= 0.5 * total and total >= 1.5 * len(runs)
    # entries of a menu stand alone; where lines have marks in or after them they are verse or captions
    menu = 4 * sum(k in ("words", "sentence") for _, k, _, _ in units) < sum(k == "label" for _, k, _, _ in units)
    for n, kind, shape, _ in units:
        kind = ("stuffed" if stuffed else "words") if kind == "run" else "words" if kind == "label" and not menu else kind
        if kind:
            kinds[kind] += n
        if kind in SPAM_KINDS:
            shapes[shape] += n
    return {"units": len(units), "kinds": kinds, "few": sum(c for _, c in shapes.most_common(8)), "spam": sum(shapes.values()), "chars": sum(kinds.values()), "top": [s for s, _ in shapes.most_common(2)]}


def page_shapes(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_units, n_chars, spam_chars, few_chars, short_chars, profile of every page.

    spam_chars counts characters in non-sentence shapes, few_chars those in the eight commonest of them,
    short_chars those in labels; profile names the two commonest, '-' where there are none. Null and blank texts
    have zeros; null doc_ids and repeated rows are kept as they come; extra columns are ignored. Texts of any
    length are read whole.
    """

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, t in pdf.itertuples(index=False):
                p = page_profile(t) if isinstance(t, str) else page_profile("")
                out.append((doc, p["units"], p["chars"], p["spam"], p["few"], p["kinds"]["label"], " ".join(p["top"]) or "-"))
            yield pd.DataFrame(out, columns=["doc_id", "n_units", "n_chars", "spam_chars", "few_chars", "short_chars", "profile"])

    return documents.select("doc_id", F.col(text).alias("text")).mapInPandas(profile, "doc_id bigint, n_units int, n_chars bigint, spam_chars bigint, few_chars bigint, short_chars bigint, profile string")


def _flagged(share: float, few_share: float, min_units: int):
    return (F.col("n_chars") > 0) & (F.col("n_units") >= min_units) & (F.col("spam_chars") > share * F.col("n_chars")) & (F.col("few_chars") >= few_share * F.col("spam_chars"))


def spam_pages(shapes: DataFrame, share: float = 0.5, few_share: float = 0.6, min_units: int = 1) -> DataFrame:
    """doc_id of the pages whose greater part is in few non-sentence shapes."""
    return shapes.where(_flagged(share, few_share, min_units)).select("doc_id").where("doc_id is not null").distinct()


def shape_groups(shapes: DataFrame, share: float = 0.5, few_share: float = 0.6, min_units: int = 1) -> DataFrame:
    """profile, n_pages, n_flagged, n_chars: pages grouped by their commonest non-sentence shapes, summed before the shuffle."""
    flag = _flagged(share, few_share, min_units).cast("bigint")
    return shapes.groupBy("profile").agg(F.count("*").alias("n_pages"), F.sum(flag).alias("n_flagged"), F.sum("n_chars").alias("n_chars"))
