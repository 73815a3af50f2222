"""Cutting oversized items at natural boundaries.

An item is a half-open range of code points of a text. Boundaries are kept as sorted arrays, one per
strength (paragraph, line, sentence, clause, word). A cut is the last boundary under the limit, found
by binary search over prefix sums of item sizes; the next piece begins `overlap` size units before it.
Where no boundary lies in reach, the item is cut hard at the limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.shared import latest

#: Strongest first. A boundary lies at the end of a match, so separators stay with the piece before.
LEVELS: list[tuple[str, re.Pattern]] = [
    ("paragraph", re.compile(r"\n[^\S\n]*\n+|\n(?=[　\t]| {2,})")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[。！？]+[”’」』）)]*|[.!?]+[\"'”’)]*(?=\s)")),
    ("clause", re.compile(r"[，；、：]|[,;:](?=\s|$)|;")),
    ("word", re.compile(r"\s+")),
]
PIECE_SCHEMA = "doc_id bigint, item_start bigint, item_end bigint, piece_no int, piece_start bigint, piece_end bigint, cut string"


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    return [(name, np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64)) for name, p in LEVELS]


def cut(start: int, end: int, limit: int, overlap: int, levels: list[tuple[str, np.ndarray]], sums: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of cut) of the item [start, end), none larger than limit.

    sums[i] is the size of the text before code point i; None means that sizes are code points.
    A boundary of a stronger level wins if it leaves the piece at least half full; below that the
    last boundary of any level in reach is taken. Consecutive pieces share exactly `overlap` units
    (with sums, the fewest code points that hold as many, less one where the limit leaves no room).
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    pieces: list[tuple[int, int, str]] = []
    at, reach = start, (lambda p, n: p + n) if sums is None else (lambda p, n: int(np.searchsorted(sums, sums[p] + n, "right")) - 1)
    back = (lambda p, n: p - n) if sums is None else (lambda p, n: int(np.searchsorted(sums, sums[p] - n, "left")))
    size = (lambda a, b: b - a) if sums is None else (lambda a, b: int(sums[b] - sums[a]))
    while size(at, end) > limit:
        most = max(reach(at, limit), at + 1)
        least = reach(at, overlap) + 1  # a cut further back would not move on
        half = max(least, reach(at, limit // 2))
        stop, kind = -1, "hard"
        for name, where in levels:
            k = int(np.searchsorted(where, most, "right")) - 1
            if k >= 0 and where[k] >= half:
                stop, kind = int(where[k]), name
                break
        else:
            for name, where in levels:
                k = int(np.searchsorted(where, most, "right")) - 1
                if k >= 0 and where[k] >= least and where[k] > stop:
                    stop, kind = int(where[k]), name
        if stop < 0:
            stop = most
        pieces.append((at, stop, kind))
        at = max(back(stop, overlap), at + 1)
    pieces.append((at, end, "end"))
    return pieces


def items_of(length: int, spans: list[tuple[int, int | None]]) -> list[tuple[int, int]]:
    """Items of a text: the part before the first heading, and from each heading to its end."""
    starts = sorted({s for s, _ in spans if s is not None and 0 <= s < length})
    if not starts:
        return [(0, length)]
    follows = dict(zip(starts, [*starts[1:], length]))
    items = {(s, e if e is not None and s < e <= length else follows[s]) for s, e in spans if s in follows}
    if starts[0] > 0:
        items.add((0, starts[0]))
    return sorted(items)


def oversized_pieces(documents: DataFrame, headings: DataFrame, limits: DataFrame, sizer: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """Pieces of every item of documents.raw_text that is larger than max_chars of its doc_type.

    Columns: doc_id, item_start, item_end, piece_no (from 1), piece_start, piece_end, cut (the kind of
    boundary the piece ends at; `hard` if none, `end` for the last). An item not above the limit has no
    rows here. Null or empty raw_text, null doc_id, doc_types without a limit and null limits give no
    rows; headings without heading_id, doc_id or start_pos, or starting outside the text, are ignored;
    of repeated heading_ids the latest counts; equal items of one document count once. Extra columns
    are ignored. sizer gives prefix sums of sizes (length + 1 values) to measure in other units than
    code points. Texts move once, for the join with their headings; if those are small, not at all.
    """
    spans = (
        latest(headings.select("heading_id", "doc_id", "start_pos", "end_pos", "ingested_at"), "heading_id", "ingested_at")
        .where("doc_id is not null and start_pos >= 0")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("start_pos", F.coalesce("end_pos", F.lit(-1).cast("bigint")).alias("end_pos"))).alias("spans"))
    )
    limit = limits.where("doc_type is not null and max_chars > 0").groupBy("doc_type").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    # a text below the smallest limit of its type cannot hold an oversized item; with another sizer that isn't known
    texts = documents.select("doc_id", "doc_type", "raw_text").where("doc_id is not null and raw_text is not null and raw_text <> ''").join(limit, "doc_type")
    if sizer is None:
        texts = texts.where(F.length("raw_text") > F.col("max_chars"))
    joined = texts.select("doc_id", "raw_text", "max_chars", "overlap_chars").join(spans, "doc_id", "left")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, limit, overlap, marks in pdf[["doc_id", "raw_text", "max_chars", "overlap_chars", "spans"]].itertuples(index=False):
                marks = [] if marks is None else [(m["start_pos"], m["end_pos"]) for m in marks]
                sums = None if sizer is None else sizer(text)
                large = [(a, b) for a, b in items_of(len(text), marks) if (b - a if sums is None else sums[b] - sums[a]) > limit]
                levels = boundaries(text) if large else []
                for a, b in large:
                    out += [(doc, a, b, n, s, e, kind) for n, (s, e, kind) in enumerate(cut(a, b, int(limit), int(overlap), levels, sums), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "item_start", "item_end", "piece_no", "piece_start", "piece_end", "cut"])

    return joined.mapInPandas(pieces, PIECE_SCHEMA)


def oversized_items(pieces: DataFrame) -> DataFrame:
    """p3_found: an item in more than one piece is too large."""
    return pieces.where("piece_no = 2").select("doc_id", F.col("item_start").alias("start_pos")).distinct()
