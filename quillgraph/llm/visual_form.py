"""One form for texts that look the same.

A transducer over grapheme clusters: a trie of code-point sequences, walked for the longest match at every place
of a cluster, writes the form in one pass. The trie is compiled once from rules over all of Unicode (widths, kinds
of space, invisible characters, compatibility letters, canonical accents) and a table of look-alike letters, and
is checked for conflicts: no output is changed by a second pass, and characters that differ to the eye never
come out alike.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.shared import latest, materialize

# Letters of other scripts and the Latin letters they cannot be told from in common typefaces.
LOOKALIKES = {
    "Cyrillic": ("АВЕКМНОРСТХЅІЈУԚԜӀ аеорсухѕіјԁһԛԝӏ", "ABEKMHOPCTXSIJYQWI aeopcyxsijdhqwl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ ονϳϲ", "ABEZHIKMNOPTYXCJ ovjc"),
    "Armenian": ("ՕՍՏԼ օսոհցզյ", "OUSL ounhgqj"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "Latin": ("ɑɡᴏᴄᴠᴡᴢ", "agocvwz"),
    "signs": ("‐‑∕⁄ꓸǃ∣ǀ∶", "--//.!||:"),
}
#: Format characters that are drawn.
DRAWN = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Not format characters, but drawn as nothing.
UNDRAWN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Compatibility characters whose letters look like the plain ones: ligatures, Roman numerals, radicals, digraphs.
SAME_COMPAT = [(0xFB00, 0xFB06), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5)]
#: Tags of decompositions that only name another width, place in a word, size or typeface.
SAME_TAGS = {"<wide", "<narrow", "<isolated", "<initial", "<medial", "<final", "<small", "<noBreak"}
#: Tags of decompositions that are seen: raised, lowered and circled characters, fractions, squares.
SEEN_TAGS = {"<super", "<sub", "<circle", "<fraction", "<square", "<vertical"}


def _singles() -> dict[str, str]:
    """Character -> form, by rule over all code points, outputs followed to their end."""
    table: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0x4E00 <= cp < 0xA000 or 0x20 < cp < 0x7F:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        tag = unicodedata.decomposition(ch).partition(">")[0]
        if ch.isspace() or kind in ("Zs", "Zl", "Zp"):
            table[ch] = " "
        elif (kind in ("Cf", "Cc") and cp not in DRAWN) or cp in UNDRAWN:
            table[ch] = ""
        elif tag in SAME_TAGS or tag == "<font" and cp >= 0x1D400 or tag == "<compat" and any(a <= cp <= b for a, b in SAME_COMPAT):
            table[ch] = unicodedata.normalize("NFKC", ch)
    for sources, targets in LOOKALIKES.values():
        table |= {a: b for a, b in zip(sources, targets) if a != b}
    for ch, to in table.items():
        seen = {to}
        while any(table.get(c, c) != c for c in to):
            to = "".join(table.get(c, c) for c in to)
            if to in seen:
                raise ValueError(f"conflicting rules for {ch!r}")
            seen.add(to)
        table[ch] = to
    return table


def compile_mapping() -> dict[str, str]:
    """Sequence -> form: single characters, accented look-alikes in one piece, and look-alikes followed by accents.

    Raises ValueError on a conflict: an output that a second pass would change, or two sources of one output
    that differ to the eye (by case, by an accent, or raised, lowered, circled and written as a fraction).
    """
    single = _singles()
    table = dict(single)
    of: dict[str, list[str]] = {}
    for a, b in single.items():
        if len(b) == 1 and unicodedata.category(a)[0] == "L" and b.isalpha():
            of.setdefault(b, []).append(a)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        way = unicodedata.decomposition(ch)
        if not way or way[0] == "<" or 0xAC00 <= cp < 0xD7A4:
            continue
        parts = unicodedata.normalize("NFD", ch)
        form = unicodedata.normalize("NFC", "".join(single.get(c, c) for c in parts))
        if form != ch:
            table[ch] = form
        if unicodedata.normalize("NFC", parts) == ch:
            for a in of.get(parts[0], ()):  # the same accents on a look-alike: a longer match than the letter alone
                table[a + parts[1:]] = form
    _check(table)
    return table


def _check(table: dict[str, str]) -> None:
    again = [c for to in table.values() for c in to if c in table and table[c] != c]
    if again:
        raise ValueError(f"outputs that are mapped again: {again[:9]!r}")
    seen = [k for k in table if len(k) == 1 and unicodedata.decomposition(k).partition(">")[0] in SEEN_TAGS]
    if seen:
        raise ValueError(f"visible differences that are lost: {seen[:9]!r}")
    for a, to in table.items():
        if len(a) == 1 and len(to) == 1 and a.lower() != a and table.get(a.lower(), a.lower()) == to:
            raise ValueError(f"{a!r} and its small letter come out alike")
        marks = lambda t: sum(unicodedata.combining(c) > 0 for c in unicodedata.normalize("NFKD", t))
        if to and marks(a) != marks(to):
            raise ValueError(f"{a!r} and {to!r} differ by an accent")


class Transducer:
    """Longest matches of a compiled mapping in a grapheme cluster, left to right."""

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for key, to in table.items():
            node = self.root
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = to

    def __call__(self, cluster: str) -> str:
        out, at = [], 0
        while at < len(cluster):
            node, k, end, form = self.root, at, at + 1, cluster[at]
            while k < len(cluster) and (node := node.get(cluster[k])) is not None:
                k += 1
                if "" in node:
                    end, form = k, node[""]
            out.append(form)
            at = end
        return "".join(out)


@cache
def transducer() -> Transducer:
    return Transducer(compile_mapping())


_CLUSTERS: dict[str, str] = {}
_PLAIN = regex.compile(r"[!-~\u4e00-\u9fff]+(?: [!-~\u4e00-\u9fff]+)*")
_CLUSTER = regex.compile(r"\X")


def _cluster_form(cluster: str) -> str:
    # accents in canonical order first, so that equal clusters are equal sequences
    return unicodedata.normalize("NFC", transducer()(unicodedata.normalize("NFC", cluster)))


def visual_form(text: str | None) -> str | None:
    """The form of a text; equal forms look the same. None stays None; a text that shows nothing becomes ''."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text
    out = []
    for cluster in _CLUSTER.findall(text):
        form = _CLUSTERS.get(cluster)
        if form is None:
            form = _cluster_form(cluster)
            if len(_CLUSTERS) < 100_000:
                _CLUSTERS[cluster] = form
        out.append(form)
    joined = "".join(out)
    # an accent set apart from its letter by an invisible character meets it only now
    return unicodedata.normalize("NFC", joined).strip(" ")


def with_visual_form(df: DataFrame, text: str, form: str = "visual_form") -> DataFrame:
    """df with the form of column `text`; every other column is kept, a column named `form` is replaced."""
    keep = [c for c in df.columns if c != form]

    @F.pandas_udf("string")
    def forms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: visual_form(t) if isinstance(t, str) else None)

    return df.select(*keep, forms(F.col(text)).alias(form))


def visual_classes(nodes: DataFrame, headings: DataFrame) -> DataFrame:
    """Records rec_key, doc_id, text, visual_form of node contents and heading titles.

    The latest version of a key counts. Null keys, doc_ids and texts are left out; a text that shows
    nothing has the form ''. Repeated rows count once, extra columns are ignored.
    """
    n = latest(nodes.select("node_id", "doc_id", "content", "ingested_at"), "node_id", "ingested_at").select(F.col("node_id").alias("rec_key"), "doc_id", F.col("content").alias("text"))
    h = latest(headings.select("heading_id", "doc_id", "title", "ingested_at"), "heading_id", "ingested_at").select(F.col("heading_id").alias("rec_key"), "doc_id", F.col("title").alias("text"))
    return with_visual_form(n.unionByName(h).where("doc_id is not null and text is not null"), "text")


def visual_groups(classes: DataFrame) -> DataFrame:
    """doc_id, visual_form, rec_key, text, class_key, text_key of the records whose form is also that of another text.

    class_key is the smallest rec_key of the class, text_key the smallest of the records with the very same text:
    one row a record, no pairs. Forms that show nothing make no class. The classes are found by the smallest and
    greatest text of a form, reduced before the shuffle; a form that only one text has never leaves its task.
    """
    c = materialize(classes.where("visual_form <> ''").select("doc_id", "visual_form", "rec_key", "text"), "visual-forms")
    mixed = c.groupBy("doc_id", "visual_form").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.min("rec_key").alias("class_key")).where("lo <> hi").drop("lo", "hi")
    c = materialize(c.join(mixed, ["doc_id", "visual_form"]), "visual-classes")
    same = c.groupBy("doc_id", "visual_form", "text").agg(F.min("rec_key").alias("text_key"))
    return c.join(same, ["doc_id", "visual_form", "text"])


def representative_pairs(groups: DataFrame) -> DataFrame:
    """class_key, key_a, key_b: one pair for every two different texts of a class, by their smallest keys."""
    t = groups.select("doc_id", "class_key", "text_key").distinct()
    a, b = t.withColumnRenamed("text_key", "key_a"), t.withColumnRenamed("text_key", "key_b")
    return a.join(b, ["doc_id", "class_key"]).where("key_a < key_b").select("class_key", "key_a", "key_b")


def visual_pairs(classes: DataFrame) -> DataFrame:
    """key_a < key_b of all records of one document with one non-empty form but different characters.

    For callers that need every pair named: the representative pairs are expanded by the records of their texts.
    """
    g = materialize(visual_groups(classes), "visual-groups")
    pairs = representative_pairs(g).select(F.col("key_a").alias("ta"), F.col("key_b").alias("tb"))
    of = g.select("rec_key", "text_key")
    out = pairs.join(of.select(F.col("rec_key").alias("ka"), F.col("text_key").alias("ta")), "ta").join(of.select(F.col("rec_key").alias("kb"), F.col("text_key").alias("tb")), "tb")
    return out.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
