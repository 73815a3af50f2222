"""Filling fixed-capacity containers along a space-filling curve.

Every text gets a hashed token vector, projected to three dimensions and placed on a Hilbert curve. Items
are range-sorted by that place, so neighbours in a partition are alike, and each partition fills
containers from windows of neighbours: the largest first, each into the open container it fills best.
Containers with room stay open into the next windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tokens import DEFAULT_VOCABULARY, with_tokens
from quillgraph.plans.shared import materialize

#: Items sorted at once, and containers kept open between windows.
WINDOW, OPEN = 2048, 512
SCHEMA = "container_kind string, container_id string, capacity_tokens int, doc_id bigint, token_start bigint, token_end bigint, whole boolean"


class Packer:
    """Open containers of one capacity, filled best-fit decreasing window by window."""

    def __init__(self, kind: str, capacity: int, prefix: str, open_max: int = OPEN):
        self.kind, self.capacity, self.prefix, self.open_max = kind, capacity, prefix, open_max
        self.made = 0
        self.open: list[tuple[int, int, str]] = []  # (room, -age, id), sorted
        self.window: list[tuple[int, int, int, int]] = []

    def _new(self) -> str:
        self.made += 1
        return f"{self.kind}-{self.prefix}-{self.made}"

    def add(self, doc: int, tokens: int) -> Iterator[tuple]:
        """Rows that are settled now: the full containers of a text beyond the capacity, and finished windows."""
        start = 0
        while tokens - start > self.capacity:
            yield self.kind, self._new(), self.capacity, doc, start, start + self.capacity, False
            start += self.capacity
        self.window.append((tokens - start, doc, start, tokens))
        if len(self.window) >= WINDOW:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for size, doc, start, end in sorted(self.window, key=lambda w: (-w[0], w[1], w[2])):
            k = bisect_left(self.open, (size, -(1 << 60), ""))
            if k < len(self.open):
                room, age, name = self.open.pop(k)
            else:
                name = self._new()
                room, age = self.capacity, -self.made
            yield self.kind, name, self.capacity, doc, start, end, start == 0
            if room > size:
                insort(self.open, (room - size, age, name))
        self.window = []
        if len(self.open) > self.open_max:  # the fullest are closed
            del self.open[: len(self.open) - self.open_max]


def pack(documents: DataFrame, containers: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Assignment of every text to containers of every capacity.

    Columns: container_kind, container_id, capacity_tokens, doc_id, token_start, token_end, whole (the
    text is in one container). Each token of each text is in exactly one container of every kind; only
    texts beyond the capacity are cut, into full containers and a rest that is packed like any item.
    Null and empty texts, null doc_ids and kinds with null or non-positive capacity have no rows; of a
    repeated container_kind the smallest capacity counts. Repeated documents are separate items, extra
    columns are ignored. The containers table is a handful of rows by contract and is exploded over items.
    """
    tokens = with_tokens(documents.where("doc_id is not null"), ["doc_id"], text, path, hilbert=True).where("n_tokens > 0")
    tokens = materialize(tokens, "pack-tokens")  # ranges are sampled: do not tokenize twice
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    configured = sorted(map(tuple, kinds.collect()))  # settings, one row a kind
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in configured])
    items = tokens.select("*", F.inline(kinds)) if configured else tokens.limit(0).select("*", F.lit("").alias("container_kind"), F.lit(1).alias("capacity_tokens"))
    ranged = items.repartitionByRange("container_kind", "hkey", "doc_id").sortWithinPartitions("container_kind", "hkey", "doc_id", "n_tokens")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = None
        for pdf in batches:
            out = []
            for kind, cap, doc, n in pdf[["container_kind", "capacity_tokens", "doc_id", "n_tokens"]].itertuples(index=False):
                if packer is None or packer.kind != kind:
                    if packer is not None:
                        out += packer.flush()
                    packer = Packer(kind, int(cap), str(part))
                out += packer.add(int(doc), int(n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        if packer is not None:
            yield pd.DataFrame(list(packer.flush()), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return ranged.mapInPandas(fill, SCHEMA)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, documents, tokens, the share of capacity left unused, texts cut."""
    per = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("n"), F.sum((~F.col("whole")).cast("int")).alias("cut"))
    return per.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), (1 - F.sum("t") / F.sum("capacity_tokens")).alias("unused_share"))
