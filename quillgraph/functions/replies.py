"""Rows out of replies of language models: tolerant reading of JSON, terms, decisions and whole extractions."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_MARKS = re.compile(r"[\s，,、;；|\n]+")
_PAIRS = {"[": "]", "{": "}"}


def find_json(text: str | None, opening: str = "[") -> Any:
    """The first valid JSON array or object in a reply: the whole, a fenced block, or the shortest balanced stretch that reads;
    a string that holds JSON is read again. None if there is none. One pass finds the balanced stretches, whatever their depth."""
    if not text:
        return None
    kind = list if opening == "[" else dict
    for part in (*_FENCE.findall(text), text):
        got = _read(part.strip(), kind)
        if got is not None:
            return got
        for a, b in _stretches(part, opening):
            got = _read(part[a:b], kind)
            if got is not None:
                return got
    return None


def _read(text: str, kind: type) -> Any:
    try:
        got = json.loads(text)
        if isinstance(got, str):
            got = json.loads(got)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, kind) else None


def _stretches(text: str, opening: str) -> list[tuple[int, int]]:
    """(start, end) of balanced stretches in the order of their starts; brackets inside strings do not count."""
    out, open_at, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and open_at:
            quoted = True
        elif c == opening:
            open_at.append(i)
        elif c == _PAIRS[opening] and open_at:
            out.append((open_at.pop(), i + 1))
    return sorted(out)


def terms_of(reply: str | None) -> list[str]:
    """Terms of a reply: strings of its first array, or names of its objects, else the reply cut at marks; trimmed, blank and
    repeated ones dropped, in order; two repeats in a row end the list, since the model then runs in a circle."""
    got = find_json(reply)
    if got is None:
        got = _MARKS.split(re.sub(r"^[^:：]*[:：]", "", reply.strip())) if reply else []
    names = [x if isinstance(x, str) else (x.get("term") or x.get("name") or x.get("content") or "") if isinstance(x, dict) else "" for x in got]
    out: list[str] = []
    again = 0
    for t in (str(n).strip().strip("\"'“”") for n in names):
        if not t:
            continue
        again = again + 1 if t in out else 0
        if again == 2:
            break
        if not again:
            out.append(t)
    return out


def refined(terms: list[str], reply: str | None) -> list[str]:
    """Terms after decisions (index from 1, keep, rename): three or fewer pass through; names have 2 to 20 characters and do not
    repeat; a refinement that leaves fewer than three of five or more is not taken."""
    decisions = find_json(reply)
    if len(terms) <= 3 or decisions is None:
        return list(terms)
    by = {d.get("index"): d for d in decisions if isinstance(d, dict)}
    out: list[str] = []
    for n, t in enumerate(terms, 1):
        d = by.get(n, {})
        name = str(d.get("rename") or t).strip()
        if d.get("keep", True) and 2 <= len(name) <= 20 and name.lower() not in (x.lower() for x in out):
            out.append(name)
    return list(terms) if len(out) < 3 and len(terms) >= 5 else out


def extraction(text: str, reply: str | None) -> dict[str, list[dict]]:
    """headings (level 1 to 6, title of at most 100, start), entities (term of at most 50, specificity 1 to 10, start) and relations
    (from, to, kind, weight 0 to 1) of a reply; a start that is missing or wrong is looked up in the text, -1 if it is not there."""
    got = find_json(reply, "{") or {}

    def number(x: Any, low: float, high: float, default: float) -> float:
        try:
            return min(high, max(low, float(x)))
        except (TypeError, ValueError):
            return default

    def place(name: str, at: Any) -> int:
        return at if isinstance(at, int) and text[at : at + len(name)] == name else text.find(name)

    rows = lambda key: [x for x in got.get(key) or [] if isinstance(x, dict)]
    heads = [{"level": int(number(h.get("level"), 1, 6, 1)), "title": t[:100], "start": place(t, h.get("start"))} for h in rows("headings") if (t := str(h.get("title") or "").strip())]
    ents = [{"term": t[:50], "specificity": int(number(e.get("specificity"), 1, 10, 5)), "start": place(t, e.get("start"))} for e in rows("entities") if (t := str(e.get("term") or e.get("name") or "").strip())]
    known = {e["term"] for e in ents}
    rels = [{"from": a, "to": b, "kind": str(r.get("type") or "related"), "weight": number(r.get("weight"), 0, 1, 0.5)} for r in rows("relations") if (a := str(r.get("from") or "")) in known and (b := str(r.get("to") or "")) in known and a != b]
    return {"headings": heads, "entities": ents, "relations": rels}


def reply_terms(c: Column) -> Column:
    """array of terms_of() for every reply; null gives none."""
    return F.pandas_udf(lambda s: s.map(lambda t: terms_of(t if isinstance(t, str) else None)), "array<string>")(c)


def document_kind(reply: Column) -> Column:
    """struct<doc_type, domain> of a reply, `other` and empty where they are missing."""

    def read(t: Any) -> tuple[str, str]:
        d = find_json(t if isinstance(t, str) else None, "{") or {}
        return str(d.get("docType") or "other"), str(d.get("domain") or "")

    frame = lambda s: pd.DataFrame([read(t) for t in s], columns=["doc_type", "domain"])
    return F.pandas_udf(frame, "struct<doc_type:string,domain:string>")(reply)


def is_exam(rule: Column, model: Column, confidence: Column, least: float = 0.7) -> Column:
    """The rule says so, and the model, where it was asked, agrees with enough confidence."""
    return F.coalesce(rule, F.lit(False)) & (model.isNull() | (model & (F.coalesce(confidence, F.lit(0.0)) >= least)))


# Providers that run on the own machine, and what names of models tell.
LOCAL_PROVIDERS = ["stub", "ollama", "huggingface"]
MODEL_SIZES = [("large", r"(?i)opus|gpt-4|72b|70b|max|ultra|pro\b"), ("medium", r"(?i)sonnet|gpt-3\.5|32b|34b|14b|13b|plus|turbo"), ("small", r"(?i)haiku|mini|7b|8b|3b|1\.5b|0\.5b|lite|flash")]


def is_cloud(provider: Column) -> Column:
    return provider.isNotNull() & ~F.lower(provider).isin(LOCAL_PROVIDERS)


def model_size(name: Column) -> Column:
    """large, medium or small by the first sign in the name, medium if there is none."""
    return F.coalesce(*[F.when(name.rlike(p), k) for k, p in MODEL_SIZES], F.lit("medium"))


def most_terms(length: Column) -> Column:
    """Terms wanted of a text: one for 500 characters, 50 to 200."""
    return F.greatest(F.lit(50), F.least(F.lit(200), F.floor(length / 500))).cast("int")


def warnings(provider: Column, key: Column, url: Column) -> Column:
    """Names of what a configuration lacks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(F.when(blank(provider), "provider"), F.when(is_cloud(provider) & blank(key), "key"), F.when(~blank(url) & ~url.rlike(r"^https?://"), "url")))


def affine(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two affine maps of the plane (six numbers each, column by column)."""
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def upper_median(heights: Column) -> Column:
    """The upper median of an array without its zeros; null if nothing is left."""
    h = F.array_sort(F.filter(heights, lambda x: x > 0))
    return F.get(h, F.floor(F.size(h) / 2).cast("int"))
