"""Frequency of every distinct term, kept up to date by signed deltas.

State in a shared folder, every table hash-partitioned into buckets and kept as a base and signed deltas on it:
  records (rec_id, doc_id, term, version)   what is counted of each record; term null: not counted
  pairs   (doc_id, term, n)                  occurrences of a term in a document
  terms   (term, occurrences, documents)
  docs    (doc_id, n)                        distinct terms of a document
A batch of added, changed or deleted records becomes +1 for what it brings and -1 for what it replaces; those
signs are summed per (document, term), per term and per document, and appended as deltas. Nothing that a batch
does not touch is written, and only the buckets it touches are read. When the deltas of a table outgrow a part
of its base they are merged into a new base, whose number of buckets follows its size. A manifest names what
each table is made of; a job lost half-way leaves the last one valid, and what no manifest names is removed.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.shared import latest, materialize, remove_path, scratch_path, unicode_trim

SCHEMAS = {
    "records": "rec_id string, doc_id bigint, term string, version timestamp_ntz, gen int",
    "pairs": "doc_id bigint, term string, n bigint",
    "terms": "term string, occurrences bigint, documents bigint",
    "docs": "doc_id bigint, n bigint",
}
KEYS = {"records": ["rec_id"], "pairs": ["doc_id", "term"], "terms": ["term"], "docs": ["doc_id"]}
#: Rows a bucket is made for; deltas are merged at this share of the base, or this many of them.
PER_BUCKET, MERGE_SHARE, MERGE_DELTAS = 2_000_000, 0.3, 16


def normalize_term(c: Column) -> Column:
    """Lower case, no whitespace of any kind at the ends; empty becomes null."""
    t = unicode_trim(F.lower(c))
    return F.when(t != "", t)


class TermCounts:
    """Persistent partitioned counts under `path`.

    apply() takes rows rec_id, doc_id, term, version and optionally `deleted` (null: false). Of several
    rows of one rec_id the one with the greatest version counts; a version not above the stored one is
    stale and ignored, so batches may repeat or come late. Null rec_ids are ignored; rows with null
    doc_id or term are stored but not counted. Ties in version go to the greatest (doc_id, term). An
    empty batch changes nothing. Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, per_bucket: int = PER_BUCKET):
        self.spark, self.path, self.per_bucket = spark, path or scratch_path(spark, "term-counts"), per_bucket
        self.generation = 0
        # table -> buckets, folders in order (the base first), rows of the base and of the deltas
        self.state: dict[str, dict] = {t: {"buckets": 0, "parts": [], "base": 0, "delta": 0} for t in SCHEMAS}

    @classmethod
    def open(cls, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET) -> TermCounts:
        """The state as of the last manifest."""
        me = cls(spark, path, per_bucket)
        rows = spark.read.schema("generation int, state string").json(f"{path}/manifest-*").where("state is not null")
        last = rows.orderBy(F.desc("generation")).limit(1).collect()
        if last:
            me.generation, me.state = last[0]["generation"], json.loads(last[0]["state"])
        return me

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.hash(*KEYS[name]), F.lit(self.state[name]["buckets"])).cast("int")

    def _read(self, name: str, touched_by: DataFrame | None = None) -> DataFrame:
        """Base and deltas together; with touched_by only the buckets that its keys fall into."""
        st = self.state[name]
        if not st["parts"]:
            return self.spark.createDataFrame([], SCHEMAS[name])
        parts = [self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(f"{self.path}/{name}/{p}") for p in st["parts"]]
        out = reduce(DataFrame.unionByName, parts)
        if touched_by is not None:
            hit = [r[0] for r in touched_by.select(self._bucket(name).alias("b")).distinct().collect()]  # at most as many as buckets
            out = out.where(F.col("bucket").isin(hit)) if len(hit) < st["buckets"] else out
        out = out.drop("bucket")
        if len(parts) == 1:
            return out
        if name == "records":
            pack = F.max(F.struct("gen", "doc_id", "term", "version")).alias("r")
            return out.groupBy("rec_id").agg(pack).select("rec_id", "r.doc_id", "r.term", "r.version", "r.gen")
        values = [c for c in out.columns if c not in KEYS[name]]
        return out.groupBy(*KEYS[name]).agg(*[F.sum(v).alias(v) for v in values]).where(f"{values[-1]} > 0")

    def _write(self, name: str, df: DataFrame, part: str) -> int:
        # rows of a bucket lie together before they are written, so a bucket is a few files, not one of every task
        target = f"{self.path}/{name}/{part}"
        df.withColumn("bucket", self._bucket(name)).repartition("bucket", F.pmod(F.xxhash64(*KEYS[name]), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(target)
        return self.spark.read.schema(SCHEMAS[name]).parquet(target).count()  # from the footers

    def _append(self, name: str, df: DataFrame) -> None:
        st, part = self.state[name], f"g={self.generation}"
        if not st["parts"]:
            df = materialize(df, f"counts-{name}")
            st["buckets"] = max(1, -(-df.count() // self.per_bucket))
            st["base"] = self._write(name, df, part)
        else:
            st["delta"] += self._write(name, df, part)
        st["parts"].append(part)

    def _compact(self) -> None:
        for name, st in self.state.items():
            if len(st["parts"]) > 1 and (st["delta"] > MERGE_SHARE * st["base"] or len(st["parts"]) > MERGE_DELTAS):
                merged = self._read(name)
                st["buckets"] = max(1, -(-(st["base"] + st["delta"]) // self.per_bucket))
                part = f"base={self.generation}"
                rows = self._write(name, merged, part)
                st.update(parts=[part], base=rows, delta=0)

    def _commit(self, before: set[tuple[str, str]]) -> None:
        row = [(self.generation, json.dumps(self.state))]
        self.spark.createDataFrame(row, "generation int, state string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest-{self.generation}")
        named = {(t, p) for t, st in self.state.items() for p in st["parts"]}
        for name, part in before - named:
            remove_path(self.spark, f"{self.path}/{name}/{part}")
        remove_path(self.spark, f"{self.path}/manifest-{self.generation - 1}")

    def apply(self, batch: DataFrame, compact: bool = True) -> None:
        """Merge a batch; a generation of the state is one batch."""
        before = {(t, p) for t, st in self.state.items() for p in st["parts"]}
        self.generation += 1
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        new = batch.select(F.col("rec_id").cast("string"), F.col("doc_id").cast("bigint"), F.when(~deleted, F.col("term")).alias("term"), F.col("version").cast("timestamp_ntz"))
        new = materialize(latest(new, "rec_id", "version", "doc_id", "term"), "counts-new")
        if self.state["records"]["parts"]:
            old = self._read("records", new).select("rec_id", F.struct("doc_id", "term", "version").alias("b"))
            both = new.join(old, "rec_id", "left").where("b is null or b.version is null or version > b.version")
            both = materialize(both, "counts-fresh")
        else:
            both = new.withColumn("b", F.lit(None).cast("struct<doc_id:bigint,term:string,version:timestamp_ntz>"))
        self._append("records", both.select("rec_id", "doc_id", "term", "version", F.lit(self.generation).alias("gen")))
        signs = both.select(F.explode(F.array(F.struct("doc_id", "term", F.lit(1).alias("d")), F.struct("b.doc_id", "b.term", F.lit(-1).alias("d")))).alias("s")).select("s.*")
        delta = signs.where("doc_id is not null and term is not null").groupBy("doc_id", "term").agg(F.sum("d").alias("n")).where("n <> 0")
        delta = materialize(delta, "counts-delta")
        # a pair that comes up from nothing, or goes down to it, changes the number of documents of its term
        if self.state["pairs"]["parts"]:
            had = self._read("pairs", delta).select("doc_id", "term", F.col("n").alias("had"))
            moved = delta.join(had, ["doc_id", "term"], "left").na.fill(0, ["had"])
            moved = materialize(moved.select("doc_id", "term", "n", ((F.col("had") + F.col("n") > 0).cast("int") - (F.col("had") > 0).cast("int")).alias("dd")), "counts-moved")
        else:
            moved = delta.withColumn("dd", F.lit(1))
        self._append("pairs", delta)
        self._append("terms", moved.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("dd").cast("bigint").alias("documents")))
        self._append("docs", moved.groupBy("doc_id").agg(F.sum("dd").cast("bigint").alias("n")).where("n <> 0"))
        if compact:
            self._compact()
        self._commit(before)

    def terms(self) -> DataFrame:
        """term, occurrences, documents."""
        return self._read("terms")

    def n_documents(self) -> int:
        """Documents with at least one counted term."""
        return self._read("docs").count()

    def marked(self, rare_max: int = 2, common_share: float = 0.08) -> DataFrame:
        """terms() with mark: `common` above the share of documents, else `rare` up to rare_max, else null."""
        floor = math.floor(round(common_share * self.n_documents(), 9))
        mark = F.when(F.col("documents") > floor, "common").when(F.col("documents") <= rare_max, "rare")
        return self.terms().withColumn("mark", mark)


def count_node_terms(nodes: DataFrame, since_days: int = 30) -> TermCounts:
    """Counts of graph_nodes.keyword over nodes and documents.

    Bootstraps from the rows older than the last `since_days` days of deliveries and merges the rest as a
    signed batch: newer versions of known nodes take back what they replace. Rows without ingested_at
    belong to the first batch, as the oldest version.
    """
    rows = nodes.select(F.col("node_id").alias("rec_id"), "doc_id", normalize_term(F.col("keyword")).alias("term"), F.col("ingested_at").cast("timestamp_ntz").alias("version"))
    last = nodes.agg(F.max("ingested_at")).first()[0]
    counts = TermCounts(nodes.sparkSession)
    if last is None:
        counts.apply(rows)
        return counts
    edge = F.lit(last).cast("timestamp_ntz") - F.expr(f"interval {int(since_days)} days")
    counts.apply(rows.where(F.col("version").isNull() | (F.col("version") <= edge)))
    counts.apply(rows.where(F.col("version") > edge))
    return counts
