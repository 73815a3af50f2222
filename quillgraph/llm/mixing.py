"""Mixing sources to target weights by Sainte-Lague apportionment.

Token totals per source and shard fix the size of the mixture; the size is cut into equal blocks of
tokens, which go one by one to the source with the highest quotient target / (2 held + 1), none beyond
its tokens times max_repeats. Each source's blocks are apportioned to its shards in the same way by their
tokens. Within a shard documents lie in a seeded order along a line of tokens; the quota takes the line
from its start, round after round, in whole documents; the document nearest in size to what is then
lacking completes it.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.tokens import DEFAULT_VOCABULARY, with_tokens
from quillgraph.plans.shared import materialize

#: Documents of a shard, tokens of a block, shards of a group that are apportioned together.
PER_SHARD, BLOCK, GROUP = 50_000, 512, 1000


def sainte_lague(seats: int, weights: dict, caps: dict | None = None) -> dict:
    """Seats to keys by the highest quotients weight / (2 held + 1), none above its cap; ties to the smallest key.

    Keys of weight 0 get none. Seats that no key may take are not given.
    """
    caps = caps or {}
    live = {k: Fraction(w) for k, w in weights.items() if w > 0}
    held = dict.fromkeys(weights, 0)
    if not live or seats <= 0:
        return held
    # keys that reach their cap leave the rest of the seats to the others
    free, open_ = seats, dict(live)
    while open_:
        weight = sum(open_.values())
        full = [k for k in open_ if k in caps and free * open_[k] / weight - len(live) >= caps[k]]
        if not full:
            break
        for k in full:
            held[k] = caps[k]
            free -= caps[k]
            del open_[k]
    # whole quotas but a few can be given at once: the order of quotients fills them first
    for k, w in open_.items():
        held[k] = max(0, min(caps.get(k, seats), int(free * w / sum(open_.values())) - len(live)))
    heap = [(-w / (2 * held[k] + 1), k) for k, w in live.items() if held[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(held.values())
    while left and heap:
        _, k = heapq.heappop(heap)
        held[k] += 1
        left -= 1
        if held[k] < caps.get(k, seats):
            heapq.heappush(heap, (-live[k] / (2 * held[k] + 1), k))
    return held


def _apportion(key: str):
    """applyInPandas step: the seats of a group to its rows by their tokens, none above its cap."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sainte_lague(int(pdf["seats"].iloc[0]), dict(zip(pdf[key].tolist(), pdf["held"].tolist())), dict(zip(pdf[key].tolist(), pdf["cap"].tolist())))
        return pd.DataFrame({"source": pdf["source"].iloc[0], key: list(got), "seats": list(got.values())})

    return step


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, fill: float | None = None, seed: int = 7, text: str = "text", path: str = DEFAULT_VOCABULARY, per_shard: int = PER_SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: source, doc_id, n_tokens, times (uses of the document, 1 to max_repeats). report: source,
    target_share, max_repeats, available_tokens, quota_tokens, mixture_tokens, actual_share, n_documents,
    most_repeats; one row per target, also for sources without documents. total_tokens None takes the
    largest size at which every source that has documents can reach its share of what they may reach
    together; `total_tokens` sets another size, `fill` one as a share of all tokens times their repeats. A larger size is filled by the sources that have tokens left, the shares then
    drifting as reported. Sources that aren't targets, null sources and doc_ids and texts without tokens take no
    part; of a repeated target the largest share counts; null or non-positive shares and repeats mean
    none. Repeated documents are separate records. Extra columns are ignored.
    """
    goal = targets.where("source_name is not null").groupBy("source_name").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).collect()  # settings, one row a source
    share = {r[0]: max(0.0, r[1]["target_share"] or 0.0) for r in goal}
    repeats = {r[0]: max(0, r[1]["max_repeats"] or 0) for r in goal}
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(s, repeats[s]) for s in share if share[s] > 0 and repeats[s] > 0], "source string, most int")
    docs = documents.where("doc_id is not null and source is not null").select("doc_id", "source", F.col(text).alias("text"))
    docs = docs.join(F.broadcast(wanted.select("source")), "source", "left_semi")  # one row a target: texts stay where they lie
    tokens = with_tokens(docs, ["doc_id", "source"], "text", path).where("n_tokens > 0")
    order = F.xxhash64(F.lit(seed), "doc_id")
    tokens = materialize(tokens, "mix-tokens")
    shards = max(1, -(-tokens.count() // per_shard))
    tokens = tokens.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(shards)).cast("int"))
    sums = materialize(tokens.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held")).withColumn("part", F.floor(F.col("shard") / GROUP).cast("int")), "mix-sums")
    have = dict.fromkeys(share, 0) | {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("held")).collect()}  # one row a source
    live = {s: share[s] for s in share if have[s] and share[s] > 0 and repeats[s] > 0}
    whole = sum(live.values())
    if total_tokens is None and fill is not None:
        total_tokens = int(fill * sum(have[s] * repeats[s] for s in live))
    if total_tokens is None:
        total_tokens = int(min((have[s] * repeats[s] * whole / live[s] for s in live), default=0))
    block = max(1, min(block, total_tokens // 1000 or 1))  # at least a thousand blocks, so shares come out to 0.1 %
    seats = total_tokens // block
    quota = sainte_lague(seats, live, {s: have[s] * repeats[s] // block for s in live})
    # the blocks of a source go to groups of shards, those of a group to its shards: no group grows with the data
    plan = sums.join(wanted, "source")
    given = spark.createDataFrame([(s, q) for s, q in quota.items()], "source string, seats bigint")
    parts = plan.groupBy("source", "part").agg(F.sum("held").alias("held"), F.sum(-F.floor(-F.col("held") * F.col("most") / block)).cast("bigint").alias("cap"))
    parts = parts.join(given, "source").groupBy("source").applyInPandas(_apportion("part"), "source string, part int, seats bigint")
    plan = plan.join(parts, ["source", "part"]).withColumn("cap", (-F.floor(-F.col("held") * F.col("most") / block)).cast("bigint"))
    blocks = plan.groupBy("source", "part").applyInPandas(_apportion("shard"), "source string, shard int, seats bigint")
    plan = plan.select("source", "shard", "held", "most").join(blocks, ["source", "shard"]).select("source", "shard", (F.col("seats") * block).alias("quota"), "held", "most")
    plan = materialize(plan, "mix-plan")
    line = Window.partitionBy("source", "shard").orderBy(order, "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.join(plan, ["source", "shard"]).withColumn("reach", F.sum("n_tokens").over(line))
    rounds = F.least(F.floor(F.col("quota") / F.col("held")), F.col("most"))
    part = F.when(rounds < F.col("most"), F.col("quota") - rounds * F.col("held")).otherwise(F.lit(0))
    placed = materialize(placed.select("source", "shard", "doc_id", "n_tokens", (rounds + (F.col("reach") <= part).cast("int")).cast("int").alias("times"), (part - F.col("reach")).alias("gap"), (F.col("reach") <= part).alias("taken"), "quota", "held", "most"), "mix-placed")
    # what a shard's last block still lacks is made up by the one document that comes closest to it
    lack = placed.groupBy("source", "shard").agg(F.min(F.when(F.col("taken"), F.col("gap"))).alias("gap"), F.first(part).alias("part"))
    lack = lack.select("source", "shard", F.coalesce("gap", "part").alias("lack")).where("lack > 0")
    near = placed.where(~F.col("taken") & (F.col("times") < F.col("most"))).join(lack, ["source", "shard"]).where("abs(n_tokens - lack) < lack")
    near = near.groupBy("source", "shard").agg(F.min(F.struct(F.abs(F.col("n_tokens") - F.col("lack")).alias("off"), "gap")).alias("b")).select("source", "shard", F.col("b.gap").alias("gap"), F.lit(1).alias("extra"))
    # gap falls strictly along a shard's line, so it names one row
    mixture = placed.join(near, ["source", "shard", "gap"], "left").select("source", "doc_id", "n_tokens", (F.col("times") + F.coalesce("extra", F.lit(0))).alias("times")).where("times > 0")
    goals = spark.createDataFrame([(s, share[s], repeats[s], have[s], quota.get(s, 0) * block) for s in share], "source string, target_share double, max_repeats int, available_tokens bigint, quota_tokens bigint")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mixture_tokens"), F.count("*").alias("n_documents"), F.max("times").alias("most_repeats"))
    report = goals.join(got, "source", "left").na.fill(0, ["mixture_tokens", "n_documents", "most_repeats"])
    report = report.withColumn("actual_share", F.col("mixture_tokens") / F.sum("mixture_tokens").over(Window.partitionBy()))
    return mixture, report
