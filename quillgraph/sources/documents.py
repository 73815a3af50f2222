"""Reading documents of several kinds and keeping tables with backups."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.plans.shared import remove_path

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """name, doc_type, text of text, Markdown and code files; base64 content is decoded, wrong encodings repaired."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    return d.select("name", tx.detect_type(F.col("name")).alias("doc_type"), tx.fix_mojibake(tx.decode_base64_text(F.col("text"))).alias("text"))


def slides_of(data: bytes) -> list[tuple[int, str]]:
    """(number, text) of the slides of a presentation in their order; unreadable data has none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        root = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        order = [rels.get(e.get(_R + "id"), "") for e in root.iter() if e.tag.endswith("}sldId")]
        out = []
        for n, target in enumerate(order, 1):
            slide = ElementTree.fromstring(z.read("ppt/" + target.lstrip("/").removeprefix("ppt/")))
            out.append((n, "\n".join(t for p in slide.iter(_A + "p") if (t := "".join(x.text or "" for x in p.iter(_A + "t"))))))
        return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


def word_text(data: bytes) -> str:
    """Paragraphs of a Word document, one a line; unreadable data gives ''."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """name, doc_type, raw_text of .docx and .pptx files; slides become pages with the parser's marks."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [word_text(c) if n.lower().endswith(".docx") else "\n".join(f"--- 第{k}页 ---\n{t}" for k, t in slides_of(c)) for n, c in zip(pdf["name"], pdf["content"])]
            yield pdf[["name", "doc_type"]].assign(raw_text=texts)

    d = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    return d.withColumn("doc_type", tx.detect_type(F.col("name"))).where("doc_type in ('docx', 'pptx')").select("name", "doc_type", "content").mapInPandas(parse, "name string, doc_type string, raw_text string")


def safe_id(name: str) -> str:
    """The id itself if it can name a file in a folder; paths and odd characters are refused."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", name):
        raise ValueError(f"not a valid id: {name!r}")
    return name


class TableStore:
    """Tables under a folder, each save a new generation, the last three kept; a load takes the newest that reads."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _generations(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{safe_id(name)}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"g(\d+)", s.getPath().getName())) and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def save(self, name: str, df: DataFrame) -> None:
        gens = self._generations(name)
        df.write.parquet(f"{self.path}/{name}/g{(gens[-1] if gens else 0) + 1}")
        for g in gens[: max(0, len(gens) + 1 - self.keep)]:
            remove_path(self.spark, f"{self.path}/{name}/g{g}")

    def load(self, name: str) -> DataFrame | None:
        for g in reversed(self._generations(name)):
            try:
                df = self.spark.read.parquet(f"{self.path}/{name}/g{g}")
                df.write.format("noop").mode("overwrite").save()  # reads every column, so a broken file shows now
                return df
            except Exception:  # noqa: BLE001, S112 - an unreadable generation: try the one before
                continue
        return None
