"""Binary blobs by id, and projects as bundles that can be carried from one store to another."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.ideas import PROJECT_MAX, free_names
from quillgraph.plans.shared import remove_path
from quillgraph.sources.documents import safe_id

#: Tables of a bundle and the columns each must have.
BUNDLE = {"documents": ["doc_id", "doc_name"], "graph_nodes": ["node_id", "doc_id"], "graph_edges": ["from_id", "to_id", "edge_type"], "headings": ["heading_id", "doc_id"]}


class BlobStore:
    """Bytes under ids in a folder that all executors share; ids that could leave the folder are refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{safe_id(name)}.bin")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def put(self, name: str, content: bytes) -> None:
        """Store or replace; a reader sees the old bytes or the new, never a part."""
        fs, p = self._at(name)
        part = p.suffix(".part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        fs.delete(p, False)
        fs.rename(part, p)

    def get(self, name: str) -> bytes | None:
        fs, p = self._at(name)
        if not fs.exists(p):
            return None
        row = self.spark.read.format("binaryFile").load(p.toString()).select("content").first()
        return bytes(row[0])

    def delete(self, name: str) -> bool:
        fs, p = self._at(name)
        return bool(fs.delete(p, False))

    def all(self) -> DataFrame:
        """id, content, length of all blobs, read on the cluster."""
        d = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(self.path)
        return d.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("id"), "content", "length")


def export_project(tables: dict[str, DataFrame], project: dict, project_id: int, path: str) -> None:
    """Write the documents of a project, and nodes, edges and headings that belong to them, with its own fields, under path.

    tables has the tables of BUNDLE; documents has project_id. Nodes without a document are left out; an edge goes along if
    both its ends do.
    """
    docs = tables["documents"].where(F.col("project_id") == project_id)
    ids = docs.select("doc_id").distinct()
    nodes = tables["graph_nodes"].join(ids, "doc_id", "left_semi")
    n = nodes.select("node_id").distinct()
    edges = tables["graph_edges"].join(n.select(F.col("node_id").alias("from_id")), "from_id", "left_semi").join(n.select(F.col("node_id").alias("to_id")), "to_id", "left_semi")
    out = {"documents": docs, "graph_nodes": nodes, "graph_edges": edges, "headings": tables["headings"].join(ids, "doc_id", "left_semi")}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    docs.sparkSession.createDataFrame([(json.dumps(project, default=str),)], "project string").coalesce(1).write.mode("overwrite").json(f"{path}/project")


def import_project(spark: SparkSession, path: str, taken: DataFrame, new_id: int) -> tuple[dict, dict[str, DataFrame]]:
    """(project, tables) of a bundle: missing tables and columns are an error; the name is made free of those in taken
    (column name), cut to its greatest length before; documents come under new_id."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in BUNDLE}
    for name, cols in BUNDLE.items():
        lacking = [c for c in cols if c not in tables[name].columns]
        if lacking:
            raise ValueError(f"{name} lacks {', '.join(lacking)}")
    project = json.loads(spark.read.json(f"{path}/project").first()["project"])
    name = str(project.get("project_name") or "project").strip()[:PROJECT_MAX]
    free = free_names(spark.createDataFrame([(1, name)], "id int, name string"), taken).first()["free"]
    tables["documents"] = tables["documents"].withColumn("project_id", F.lit(new_id).cast("int"))
    return project | {"project_id": new_id, "project_name": free}, tables


def add_samples(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """documents with those samples whose doc_name is not there yet; of samples of one name the smallest doc_id comes."""
    one = samples.where("doc_name is not null").groupBy("doc_name").agg(F.min("doc_id").alias("doc_id"))
    new = samples.join(one, ["doc_name", "doc_id"], "left_semi").join(documents.select("doc_name").distinct(), "doc_name", "left_anti")
    return documents.unionByName(new.select(*documents.columns))


def clear_all(spark: SparkSession, paths: list[str], token: str, given: str | None) -> None:
    """Remove whole stores, only with the token that was handed out for it."""
    if not token or given != token:
        raise PermissionError("wrong or missing token")
    for p in paths:
        remove_path(spark, p)
