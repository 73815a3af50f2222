"""Repair of text from scanned pages.

One pass over the documents counts the words and ideograph triples of clean texts, those read in scans, and
the lines at page edges, and sets the scans aside; all later steps read only those. Misreadings are mined by
joining words read in scans with known words that differ in one place; a layout model labels page furniture
and paragraph ends; every distinct word read is joined once with the known words it may be a misreading of;
and the character editor decides, character by character, on every scanned text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.editor import HYPHENED, HYPHENS, IDEOGRAPH, WORD, Editor, Inventory, Lesson, Lookup, before, difference, gap_keys, triple_counts, triples
from quillgraph.llm.page_furniture import HYPHEN_END, MARK, Layout, train_layout
from quillgraph.llm.perceptron import Perceptron
from quillgraph.plans.shared import materialize

_WORD_START = re.compile(r"[^\W_]+")
_BROKEN = re.compile(rf"[{HYPHENS}][ \t]*\n\s*")
_CJK = re.compile(IDEOGRAPH)
_BLANKS = " \t\r\f　"
#: Partial counts, and characters they were taken from, that a task holds before it passes them on.
FLUSH, FLUSH_CHARS = 200_000, 8_000_000


def looks_scanned(text: str) -> bool:
    """Lines are set to a width: no line is much longer than most, and most full ones stop in the middle of a sentence."""
    lines = [s.rstrip() for s in text.split("\n") if s.strip()]
    if len(lines) < 4:
        return False
    lengths = sorted(map(len, lines))
    width = lengths[int(0.9 * (len(lines) - 1))]
    full = [s for s in lines[:-1] if len(s) >= 0.75 * width]
    broken = sum(not re.search(r"[.!?。！？:：;；]['\"”’)]*$", s) for s in full)
    return len(full) >= 3 and lengths[-1] <= 1.35 * width + 2 and broken >= 0.6 * len(full)


def _edge_lines(text: str) -> dict[str, int] | None:
    """Folded line -> 0 if it stands only in the opening of a text, 1 at a page edge, 2 inside a page; None without marked pages."""
    lay = Layout(text.split("\n"))
    if not lay.paged:
        return None
    opening = set(lay.body[:2])
    seen: dict[str, int] = {}
    for i in lay.body:
        s = lay.text[i]
        if i in lay.key and i not in lay.mixed and len(s) <= 3 or i not in lay.key or re.search(r"\d|[.。，,:：?？!]", re.sub(r"^\d+\s{2,}|\s{2,}\S{1,4}$", "", s)):
            continue
        k = lay.key[i]
        seen[k] = max(seen.get(k, 0), 0 if i in opening else 1 if i in lay.place else 2)
    return seen


_SURVEY = "what string, key string, n bigint, inner bigint, opening bigint, doc_id bigint, text string"


def survey(documents: DataFrame, share: float, seed: int, per_text: int = 40) -> DataFrame:
    """What one pass over the documents finds, written partitioned by `what`:

    word, triple: counts over the texts of documents that are no scans; read, readtriple: over scans; edge,
    pages: lines at page edges and the number of texts with marked pages; scan: the scans themselves;
    sample: lines of clean texts chosen by a hash of doc_id, at most `per_text` of each, drawn over the whole text.
    A scan has raw_text, and is_scanned true, or null and lines that are set to a width.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # words are taken from the distinct strings between blanks, which are far fewer than all
        counts: dict[str, Counter] = {k: Counter() for k in ("word", "triple", "read", "readtriple")}
        edges: dict[str, list[int]] = {}
        marked, held = 0, 0

        def take() -> pd.DataFrame:
            for what in ("word", "read"):
                words: Counter = Counter()
                for chunk, n in counts[what].items():
                    for w in WORD.findall(chunk):
                        if not w.isdigit():
                            words[w] += n
                    if "-" in chunk:
                        for w in HYPHENED.findall(chunk):
                            if "-" in w:
                                words[w] += n
                counts[what] = words
            rows = [(what, k, n, 0, 0, None, None) for what, c in counts.items() for k, n in c.items()]
            rows += [("edge", k, *v, None, None) for k, v in edges.items()]
            for c in counts.values():
                c.clear()
            edges.clear()
            return pd.DataFrame(rows, columns=["what", "key", "n", "inner", "opening", "doc_id", "text"])

        for pdf in batches:
            out = []
            texts: dict[str, list[str]] = {"word": [], "read": []}
            for doc, text, raw, flag, chosen in pdf.itertuples(index=False):
                scan = isinstance(raw, str) and raw != "" and (flag is True or flag == 1 or (flag is None or flag != flag) and looks_scanned(raw))
                if scan:
                    texts["read"].append(_BROKEN.sub("", raw))
                    seen = _edge_lines(raw)
                    if seen is not None:
                        marked += 1
                        for k, v in seen.items():
                            e = edges.setdefault(k, [0, 0, 0])
                            e[0] += v < 2
                            e[1] += v == 2
                            e[2] += v == 0
                    if doc == doc and doc is not None:
                        out.append(("scan", None, 1, 0, 0, int(doc), raw))
                elif isinstance(text, str):
                    texts["word"].append(text)
                    if chosen:
                        lines = [s for s in text.split("\n") if s.strip()]
                        rng = random.Random(int(doc) + seed)
                        some = sorted(rng.sample(range(len(lines)), min(per_text, len(lines))))
                        out.append(("sample", None, len(some), 0, 0, int(doc), "\n".join(lines[k] for k in some)))
            if out:
                yield pd.DataFrame(out, columns=["what", "key", "n", "inner", "opening", "doc_id", "text"])
            for what, trips in (("word", "triple"), ("read", "readtriple")):
                for t in texts[what]:
                    counts[what].update(t.split())
                    held += len(t)
                for k, n in zip(*triple_counts(texts[what])):
                    counts[trips][k] += n
            if held > FLUSH_CHARS or sum(map(len, counts.values())) + len(edges) > FLUSH:
                held = 0
                yield take()
        last = take()
        yield pd.concat([last, pd.DataFrame([("pages", None, marked, 0, 0, None, None)], columns=last.columns)], ignore_index=True)

    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share) + 1)
    d = documents.select("doc_id", "text", "raw_text", "is_scanned", (F.coalesce(spread, F.lit(False)) & F.col("doc_id").isNotNull()).alias("chosen"))
    return d.mapInPandas(run, _SURVEY)


def notices(edges: DataFrame, marked: int, least_share: float = 0.01) -> frozenset[str]:
    """Lines, folded, that stand at the page edges of several documents and hardly anywhere else.

    A notice stands in two texts and in `least_share` of those with marked pages at least, however many there
    are, so no more than the mean number of edge lines of a text divided by that share can be notices. A line
    that in half of its texts stands only among the first two lines is a title.
    """
    least = max(2, ceil(least_share * marked))
    sums = edges.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "inner", "opening")])
    rows = sums.where(f"n >= {least} and n >= 0.9 * (n + inner) and opening < 0.5 * n").select("key").collect()
    return frozenset(r["key"] for r in rows)


def mine(counts: DataFrame, least_share: float = 0.004, least: int = 3) -> dict[tuple[str, str], float]:
    """(read, stood) -> support of the misreadings seen in scans.

    Words and triples that are read in scans and never written in clean texts are joined with the written ones
    that differ in one place; every one of them gives its candidates one vote together. A misreading has
    `least_share` of all votes and `least` different words: so at most 1 / least_share come out.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, w, kind) for w, kind in pdf.itertuples(index=False) for k in (gap_keys(w) if kind == "w" else [w[0] + "*" + w[2]])]
            yield pd.DataFrame(rows, columns=["gap", "word", "kind"])

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, w in pdf.itertuples(index=False):
                _, r, s = difference(u, w)
                # an added letter alone is how words are inflected, and digits are not read out of words
                if r and s and len(r) <= 2 and len(s) <= 2:
                    rows.append((u, r, s))
            yield pd.DataFrame(rows, columns=["u", "r", "s"])

    kind = F.when(F.col("what").isin("word", "read"), "w").otherwise("t").alias("kind")
    fair = F.when(kind == "w", (F.length("key") >= 4) & F.col("key").rlike(r"\p{L}")).otherwise(F.length("key") == 3)
    read = counts.where("what in ('read', 'readtriple')").where(fair).select("key", kind)
    known = counts.where("what in ('word', 'triple')").where(fair)
    unknown = read.join(known.select("key", kind), ["key", "kind"], "left_anti")
    # an ideograph is out of place only if it is so beside both neighbours
    side = lambda a, b: F.concat(F.lit(a), F.substring("key", b, 2))
    pairs = counts.where("what = 'triple'").select(F.explode(F.array(side("l", 1), side("r", 2))).alias("pair")).distinct()
    odd = unknown.where("kind = 't'").withColumns({"l": side("l", 1), "r": side("r", 2)})
    odd = odd.join(pairs.withColumnRenamed("pair", "l"), "l", "left_anti").join(pairs.withColumnRenamed("pair", "r"), "r", "left_anti").select("key", "kind")
    unknown = materialize(unknown.where("kind = 'w'").unionByName(odd), "scan-unknown")
    a = unknown.mapInPandas(keys, "gap string, word string, kind string").withColumnRenamed("word", "u")
    b = known.where("n >= 2").select("key", kind).mapInPandas(keys, "gap string, word string, kind string")
    # sizes of what comes out of Python are not known to the planner: never a broadcast
    pairs = a.hint("merge").join(b.hint("merge"), ["gap", "kind"]).select("kind", "u", "word").distinct().where("u <> word")
    ops = pairs.select("u", "word").mapInPandas(changes, "u string, r string, s string")
    mates = ops.groupBy("u").agg(F.count("*").alias("m"))
    votes = ops.hint("merge").join(mates.hint("merge"), "u").groupBy("r", "s").agg(F.sum(F.lit(1.0) / F.col("m")).alias("v"), F.countDistinct("u").alias("n"))
    votes = materialize(votes, "scan-ops").withColumn("cjk", F.col("r").rlike(IDEOGRAPH))
    total = {r["cjk"]: r["t"] for r in votes.groupBy("cjk").agg(F.sum("v").alias("t")).collect()}
    out = {}
    for cjk, t in total.items():
        for r in votes.where((F.col("cjk") == cjk) & (F.col("v") >= least_share * t) & (F.col("n") >= least)).collect():
            out[r["r"], r["s"]] = r["v"] / t
    return out


def _word_keys(word: str, inventory: Inventory) -> list[str]:
    return [*gap_keys(word), *("=" + k for k in inventory.fold(word))]


def look_up(queries: DataFrame, counts: DataFrame, inventory: Inventory, ratio: int = 4) -> DataFrame:
    """kind, q, info of distinct queries: words (w) with their own count and the known words that they may be misreadings
    of, `ratio` times as frequent at least; triples (t) with the counts of the pairs around every ideograph that may
    have stood in the middle. Words meet by an equi-join on keys: the word with a gap, for one misreading of any kind,
    and its form with all known misreadings folded together, for any number of known ones."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, w, n) for w, n in pdf.itertuples(index=False) for k in _word_keys(w, inventory)]
            yield pd.DataFrame(rows, columns=["gap", "word", "n"])

    def one_place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [max(map(len, difference(q, w)[1:])) <= 2 for q, w in zip(pdf["q"], pdf["word"])]
            yield pdf.loc[keep, ["q", "word", "n"]]

    def middles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (t,) in pdf.itertuples(index=False):
                for x in (t[1], *inventory.by_read.get(t[1], ())):
                    rows += [(t, x, 0, "l" + t[0] + x), (t, x, 1, "r" + x + t[2])]
            yield pd.DataFrame(rows, columns=["q", "x", "side", "pair"])

    words = counts.where("what = 'word'").select("key", "n")
    q = queries.where("kind = 'w'").select("q").join(words.select(F.col("key").alias("q"), F.col("n").alias("own")), "q", "left").na.fill(0, ["own"])
    has_letter = F.lit(r"\p{L}")
    a = q.where(F.regexp_like("q", has_letter) & (F.length("q") > 1)).select("q", "own").mapInPandas(keys, "gap string, word string, n bigint").select("gap", F.col("word").alias("q"), F.col("n").alias("own"))
    b = words.where(F.regexp_like("key", has_letter) & (F.length("key") > 1) & ~F.col("key").contains("-")).mapInPandas(keys, "gap string, word string, n bigint")
    met = a.hint("merge").join(b.hint("merge"), "gap").where((F.col("word") != F.col("q")) & (F.col("n") >= ratio * F.col("own")))
    # words that met by a half need not be alike in the other
    alike = met.where(~F.substring("gap", 1, 1).isin("<", ">")).select("q", "word", "n")
    mates = alike.unionByName(met.where(F.substring("gap", 1, 1).isin("<", ">")).mapInPandas(one_place, "q string, word string, n bigint")).distinct()
    mates = mates.groupBy("q").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "word", F.col("n").cast("string")))), ",").alias("mates"))
    w = q.hint("merge").join(mates.hint("merge"), "q", "left").where("own > 0 or mates is not null").select(F.lit("w").alias("kind"), "q", F.concat_ws("\t", F.col("own").cast("string"), F.coalesce("mates", F.lit(""))).alias("info"))
    trip = counts.where("what = 'triple'")
    pairs = trip.select(F.explode(F.array(F.concat(F.lit("l"), F.substring("key", 1, 2)), F.concat(F.lit("r"), F.substring("key", 2, 2)))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    m = queries.where("kind = 't'").select("q").mapInPandas(middles, "q string, x string, side int, pair string").hint("merge").join(pairs.hint("merge"), "pair", "left").na.fill(0, ["n"])
    m = m.groupBy("q", "x").agg(F.max(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("r"))
    t = m.groupBy("q").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "x", F.col("l").cast("string"), F.col("r").cast("string")))), ",").alias("info"))
    return w.unionByName(t.select(F.lit("t").alias("kind"), "q", "info"))


def _parse(rows: list[str], total: float, pairs: float) -> Lookup:
    """A Lookup of lines kind, query, info."""
    words, trips = {}, {}
    for row in rows:
        if row[0] == "w":
            _, q, own, mates = row.split("\t")
            words[q] = int(own), [(w, int(n)) for w, n in (m.rsplit(":", 1) for m in mates.split(","))] if mates else []
        else:
            q, _, info = row[2:].partition("\t")
            # an ideograph is one character, so the parts are found from its place
            trips[q] = {m[0]: tuple(map(int, m[2:].split(":"))) for m in info.split(",")}
    return Lookup(words, trips, total, pairs)


class Page:
    """One scanned text, read whole, with its layout: what stands on it, before any character is changed."""

    def __init__(self, text: str, kinds: dict[int, str], ends: set[int]):
        self.lines, self.kinds, self.ends = text.split("\n"), kinds, ends
        self.hyphens: set[int] = set()
        self.misread: dict[int, list] = {}
        self.paragraphs: list[str] = []

    def solid(self) -> list[int]:
        return [i for i, s in enumerate(self.lines) if i not in self.kinds and s.strip(_BLANKS) and not MARK.match(s.strip("\f \r"))]

    def read(self, solid: list[int], join) -> list[tuple[str, list[tuple[int, int]]]]:
        """(text, [(start, line)]) of every paragraph; join(left, mark, right) decides on broken words."""
        out, para, places, length = [], [], [], 0
        # lines of ideographs are cut anywhere, those of other scripts between words
        cjk = sum(len(_CJK.findall(self.lines[i])) for i in solid) * 3 > sum(len(self.lines[i]) for i in solid)
        for n, i in enumerate(solid):
            line = self.lines[i].strip(_BLANKS)
            places.append((length, i))
            follow = self.lines[solid[n + 1]].strip(_BLANKS) if n + 1 < len(solid) else ""
            glue = " "
            m = HYPHEN_END.search(line)
            w = _WORD_START.match(follow)
            if m and w and not m.group(1).isdigit():
                stem = line.rstrip()
                if join(m.group(1), stem[-1], w.group(), i) == "drop":
                    line, glue = stem[:-1], ""
                else:
                    line, glue = stem[:-1] + "-", ""
            elif cjk:
                # a blank that the line was cut at stays; two and more are an indent
                raw, nxt = self.lines[i].rstrip("\r"), self.lines[solid[n + 1]].lstrip("\f") if n + 1 < len(solid) else ""
                glue = " " if raw.endswith(" ") or nxt[:1] == " " and nxt[1:2] not in (" ", "　") else ""
            last = i in self.ends and not (m and w) or n + 1 == len(solid)
            para += [line] if last else [line, glue]
            length += len(line) + (0 if last else len(glue))
            if last:
                out.append(("".join(para).rstrip(), places))
                para, places, length = [], [], 0
        return out

    def queries(self, inventory: Inventory) -> tuple[set[str], set[str]]:
        """(words, triples) that repair() will look up."""
        words: set[str] = set()

        def join(left: str, mark: str, right: str, _line: int) -> str:
            words.update((left, right, left + right, f"{left}-{right}"))
            return "drop"

        trips: set[str] = set()
        for text, places in self.read(self.solid(), join):
            if _is_body(text, places):
                words.update(WORD.findall(text))
                trips.update(t for t in triples(f" {text} ") if t[1] in inventory.by_read)
        words = {w for w in words if not w.replace(".", "").isdigit()}
        return words | {w.lower() for w in words if w[:1].isupper()}, trips

    def repair(self, editor: Editor, look: Lookup) -> None:
        def join(left: str, mark: str, right: str, line: int) -> str:
            op = editor.join(left, mark, right, look)
            if op == "drop":
                self.hyphens.add(line)
            return op

        paras = self.read(self.solid(), join)
        seen = Counter(w for text, _ in paras for w in WORD.findall(text))
        for text, places in paras:
            self.paragraphs.append(self._edit(text, places, seen, editor, look) if _is_body(text, places) else text)

    def _edit(self, text: str, places: list[tuple[int, int]], seen: Counter, editor: Editor, look: Lookup) -> str:
        edits: list[tuple[int, int, str]] = []
        for m in WORD.finditer(text):
            w = m.group()
            if w.replace(".", "").isdigit():
                continue
            out = editor.word(w, before(text, m.start()), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1], seen[w], look)
            if out is not None:
                edits.append((m.start(), m.end(), "".join(out)))
                for k, (c, o) in enumerate(zip(w, out)):
                    if c != o:
                        self._note(m.start() + k, places, c, o)
        wide = f" {text} "
        for i in range(len(text)):
            if text[i] in editor.inventory.by_read:
                opts = editor.ideograph(wide[i : i + 3], look)
                k = editor.model.best(list(opts.values())) if len(opts) > 1 else 0
                if k:
                    edits.append((i, i + 1, list(opts)[k]))
                    self._note(i, places, text[i], list(opts)[k])
        out, at = [], 0
        for a, b, to in sorted(edits):
            if a >= at:
                out += [text[at:a], to]
                at = b
        return "".join(out) + text[at:]

    def _note(self, at: int, places: list[tuple[int, int]], read: str, stood: str) -> None:
        line = places[bisect_right(places, (at, 1 << 60)) - 1][1]
        self.misread.setdefault(line, []).append((read, stood))

    def cases(self) -> list[tuple[int, str]]:
        """(line number from 1, kind)."""
        return sorted([(i + 1, k) for i, k in self.kinds.items()] + [(i + 1, "hyphen") for i in self.hyphens] + [(i + 1, "misread") for i in self.misread])


def _is_body(text: str, places: list) -> bool:
    """A paragraph; a line alone that ends in no mark is a title, a heading or a row of a table."""
    return len(places) > 1 or bool(re.search(r"[.!?。！？,，;；:：-]['\"”’」』）)]*$", text))


def lay_out(scans: DataFrame, shared, inventory: Inventory) -> DataFrame:
    """row, doc_id, text, kinds, ends and the queries (kind + word or triple) of every scan; row tells equal doc_ids apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, known = shared.value
        model = Perceptron(weights)
        for pdf in batches:
            out = []
            for row, doc, text in pdf.itertuples(index=False):
                lay = Layout(text.split("\n"), known)
                kinds = lay.label(model)
                ends = lay.breaks(kinds, model)[1]
                words, trips = Page(text, kinds, ends).queries(inventory)
                out.append((row, doc, text, [{"line": i, "kind": k} for i, k in kinds.items()], sorted(ends), ["w" + w for w in words] + ["t" + t for t in trips]))
            yield pd.DataFrame(out, columns=["row", "doc_id", "text", "kinds", "ends", "queries"])

    numbered = scans.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInPandas(run, "row bigint, doc_id bigint, text string, kinds array<struct<line:int,kind:string>>, ends array<int>, queries array<string>")


def repair(documents: DataFrame, sample_lines: int = 3000, seed: int = 7) -> DataFrame:
    """doc_id, text (repaired paragraphs, one a line), cases (line_no, kind) of every scanned document.

    Both models are fitted on a bounded sample of at most `sample_lines` lines of clean documents; all counts,
    the misreadings, the notices and the words that are looked up cover all documents. Null or empty raw_text
    and null doc_id have no row; a text of blank lines gives an empty text and no cases. Repeated rows are
    repaired each; ties between operations go to keeping the text as it is. Extra columns are ignored.
    """
    spark = documents.sparkSession
    share = 0.5 * sample_lines / max(1, documents.count())
    found = materialize(survey(documents, share, seed), "scan-survey", partition_by="what")
    counts = found.where(F.col("what").isin("word", "triple", "read", "readtriple")).groupBy("what", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "scan-counts", partition_by="what")
    totals = {r["what"]: r["n"] for r in counts.groupBy("what").agg(F.sum("n").alias("n")).collect()}
    total, pairs = float(totals.get("word") or 1), float(totals.get("triple") or 1)
    marked = found.where("what = 'pages'").agg(F.sum("n")).first()[0] or 0
    known = notices(found.where("what = 'edge'"), marked)
    inventory = Inventory(mine(counts))
    rows = found.where("what = 'sample'").select("doc_id", "text").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "text").limit(sample_lines).collect()
    texts, n = [], 0
    for r in rows:  # whole samples of texts up to the bound
        n += r["text"].count("\n") + 1
        if n > sample_lines and texts:
            break
        texts.append(r["text"])
    lines = [s for t in texts for s in t.split("\n")]
    lesson = Lesson(lines, inventory, seed)
    layout = spark.sparkContext.broadcast((train_layout(texts, seed), known))
    laid = materialize(lay_out(found.where("what = 'scan'"), layout, inventory), "scan-layout")
    asked = laid.select("row", F.explode("queries").alias("kq")).select("row", F.substring("kq", 1, 1).alias("kind"), F.expr("substring(kq, 2)").alias("q"))
    lw, lt = lesson.queries()
    taught = spark.createDataFrame([("w", w) for w in sorted(lw)] + [("t", t) for t in sorted(lt)] or [("w", "")], "kind string, q string")
    info = materialize(look_up(asked.select("kind", "q").unionByName(taught).distinct(), counts, inventory), "scan-lookup")
    line = F.concat_ws("\t", "kind", "q", "info")
    study = info.join(F.broadcast(taught), ["kind", "q"], "left_semi").select(line).collect()  # no more rows than the sample asks for
    weights = lesson.train(inventory, _parse([r[0] for r in study], total, pairs))
    told = asked.hint("merge").join(info.hint("merge"), ["kind", "q"]).groupBy("row").agg(F.collect_list(line).alias("told"))
    trained = spark.sparkContext.broadcast((inventory.support, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        support, weights = trained.value
        editor = Editor(Inventory(support), weights)
        for pdf in batches:
            out = []
            for doc, text, kinds, ends, told in pdf.itertuples(index=False):
                page = Page(text, {k["line"]: k["kind"] for k in kinds}, set(ends))
                page.repair(editor, _parse(list(told) if told is not None else [], total, pairs))
                out.append((doc, "\n".join(page.paragraphs), [{"line_no": n, "kind": k} for n, k in page.cases()]))
            yield pd.DataFrame(out, columns=["doc_id", "text", "cases"])

    both = laid.drop("queries").hint("merge").join(told.hint("merge"), "row", "left").select("doc_id", "text", "kinds", "ends", "told")
    return both.mapInPandas(run, "doc_id bigint, text string, cases array<struct<line_no:int,kind:string>>")


def scan_cases(repaired: DataFrame) -> DataFrame:
    """doc_id, line_no, kind."""
    return repaired.select("doc_id", F.explode("cases").alias("c")).select("doc_id", "c.line_no", "c.kind").distinct()
