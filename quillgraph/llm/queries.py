"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import mixing, packing, page_shapes, scan_repair, splitting, term_counts, visual_form
from quillgraph.plans.shared import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_counts.count_node_terms(table(spark, sf_dir, "graph_nodes"))
    return counts.marked().where("mark is not null").select(F.col("term").alias("keyword"), "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_counts.count_node_terms(table(spark, sf_dir, "graph_nodes"))
    return counts.marked().select(F.col("term").alias("keyword"), "occurrences", "documents", F.coalesce("mark", F.lit("-")).alias("mark"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.scan_cases(scan_repair.repair(table(spark, sf_dir, "documents")))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repair(table(spark, sf_dir, "documents")).select("doc_id", "text", F.size("cases").alias("n_cases"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_pieces(*(table(spark, sf_dir, t) for t in ("documents", "headings", "split_limits")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_items(p3_pieces(spark, sf_dir))


def p3_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per doc_type: items cut, pieces that are too long, gaps or wrong overlaps between pieces, items not covered."""
    p = p3_pieces(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "doc_type"), "doc_id")
    p = p.join(F.broadcast(table(spark, sf_dir, "split_limits").groupBy("doc_type").agg(F.min("max_chars").alias("most"), F.min("overlap_chars").alias("over"))), "doc_type")  # settings
    w = Window.partitionBy("doc_id", "item_start", "item_end").orderBy("piece_no")
    p = p.withColumn("before", F.lag("piece_end").over(w)).withColumn("after", F.lead("piece_no").over(w))
    bad = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return p.groupBy("doc_type").agg(
        bad(F.col("piece_no") == 1).alias("n_items"),
        bad(F.col("piece_end") - F.col("piece_start") > F.col("most")).alias("too_long"),
        bad(F.col("before") - F.col("piece_start") != F.least(F.col("over"), F.col("most") - 1)).alias("wrong_overlap"),
        bad((F.col("before").isNull() & (F.col("piece_start") != F.col("item_start"))) | (F.col("after").isNull() & (F.col("piece_end") != F.col("item_end")))).alias("uncovered"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.visual_pairs(visual_form.visual_classes(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "headings")))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf_dir))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: documents packed, containers above their capacity, documents with a gap or an overlap."""
    p = materialize(p6_pack(spark, sf_dir), "pack-checked")
    full = p.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"))
    full = full.groupBy("container_kind", "capacity_tokens").agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("bigint")).alias("overfull"))
    d = p.groupBy("container_kind", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.max("token_end").alias("end"), F.countDistinct("token_start").alias("k"), F.count("*").alias("n"))
    d = d.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.sum(((F.col("t") != F.col("end")) | (F.col("k") != F.col("n"))).cast("bigint")).alias("torn"))
    return full.join(d, "container_kind").select("container_kind", "capacity_tokens", "n_docs", "overfull", "torn")


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: uses above max_repeats, documents of another source, in a mixture of half of all that repeating allows."""
    mixture = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), fill=0.5)[0]
    m = mixture.join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own")), "doc_id")
    m = m.groupBy("source").agg(F.max("times").alias("most"), F.sum((F.col("own") != F.col("source")).cast("bigint")).alias("foreign"))
    t = table(spark, sf_dir, "mix_targets").groupBy("source_name").agg(F.max("max_repeats").alias("max_repeats"))
    j = t.join(m, F.col("source_name") == F.col("source"), "left")
    return j.select("source_name", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("above"), F.coalesce("foreign", F.lit(0)).cast("bigint").alias("foreign"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all that repeating allows: repeats and shares that drift on most of the documents."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), fill=0.5)[1]


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shapes.shape_groups(page_shapes.page_shapes(table(spark, sf_dir, "documents")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.visual_groups(visual_form.visual_classes(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "headings"))).drop("text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shapes.spam_pages(page_shapes.page_shapes(table(spark, sf_dir, "documents")))


def p8_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shapes.page_shapes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_checked": p3_checked,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_checked": p6_checked,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_full": p7_full,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_shapes": p8_shapes,
    "p8_groups": p8_groups,
}

_BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]"
_P1 = rf"""
with v as (select *, row_number() over (partition by node_id order by ingested_at desc nulls last, doc_id desc nulls last, keyword desc nulls last) rn from graph_nodes where node_id is not null),
k as (select doc_id, regexp_replace(regexp_replace(lower(keyword), '^{_BLANK}+', ''), '{_BLANK}+$', '') keyword from v where rn = 1 and doc_id is not null and keyword is not null),
c as (select keyword, count(*) occurrences, count(distinct doc_id) documents from k where keyword <> '' group by 1),
n as (select count(distinct doc_id) n from k where keyword <> ''),
m as (select keyword, occurrences, documents, case when documents > 0.08 * n then 'common' when documents <= 2 then 'rare' else '-' end mark from c, n)
"""
_P3 = """
with v as (select *, row_number() over (partition by heading_id order by ingested_at desc nulls last) rn from headings where heading_id is not null),
d as (select doc_id, length(raw_text) len, max_chars from documents join split_limits using (doc_type) where raw_text is not null),
h as (select doc_id, start_pos, end_pos, len, max_chars from v join d using (doc_id) where rn = 1 and start_pos between 0 and len - 1),
s as (select doc_id, start_pos, lead(start_pos) over (partition by doc_id order by start_pos) nxt from (select distinct doc_id, start_pos from h)),
i as (select h.doc_id, h.start_pos, case when end_pos is null or end_pos <= h.start_pos or end_pos > len then coalesce(nxt, len) else end_pos end end_pos, max_chars from h join s on h.doc_id = s.doc_id and h.start_pos = s.start_pos
  union all select d.doc_id, 0, coalesce(f, len), max_chars from d left join (select doc_id, min(start_pos) f from h group by 1) using (doc_id) where f is null or f > 0)
"""
ORACLES = {
    "p1_found": _P1 + "select keyword, mark from m where mark <> '-'",
    "p1_counts": _P1 + "select keyword, occurrences, documents, mark from m",
    "p3_found": _P3 + "select distinct doc_id, cast(start_pos as bigint) start_pos from i where end_pos - start_pos > max_chars",
    "p3_checked": _P3 + "select doc_type, count(*) n_items, cast(0 as bigint) too_long, cast(0 as bigint) wrong_overlap, cast(0 as bigint) uncovered from (select distinct doc_id, start_pos, end_pos from i where end_pos - start_pos > max_chars) join documents using (doc_id) group by 1",
    "p6_checked": "select container_kind, min(capacity_tokens) capacity_tokens, (select count(distinct doc_id) from documents where text <> '') n_docs, cast(0 as bigint) overfull, cast(0 as bigint) torn from containers where capacity_tokens > 0 group by 1",
    "p7_checked": "select source_name, false above, cast(0 as bigint) \"foreign\" from mix_targets where source_name is not null group by 1",
}
