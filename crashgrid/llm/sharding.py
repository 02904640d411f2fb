"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from crashgrid.llm.registry import query
from crashgrid.session import cut, drop_cut

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Feistel:
    """Permutation of [0, n): a balanced network over the next power of four, walked until it falls below n.

    ``n`` and ``seed`` decide everything, so any task can compute any position, and ``inverse``
    tells which row number stands at a position.
    """

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, ((max(self.n - 1, 1)).bit_length() + 1) // 2)

    def _mix(self, part: np.ndarray, k: int) -> np.ndarray:
        """A round's function: 64-bit mixing of one half with seed and round, cut to half the bits."""
        key = np.uint64((self.seed * _ODD[0] + (k + 1) * _ODD[1]) % 2**64)
        x = (part ^ key) * np.uint64(_ODD[1])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[2])
        return (x ^ (x >> np.uint64(32))) & np.uint64(2**self.half - 1)

    def _network(self, x: np.ndarray, order) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64(2**self.half - 1)
        left, right = x >> h, x & mask
        for k in order:
            left, right = right, left ^ self._mix(right, k)
        return (right << h) | left  # halves swapped, so that the reverse order of rounds inverts it

    def _walk(self, x: np.ndarray, order) -> np.ndarray:
        x = np.asarray(x, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out = self._network(x, order)
            while (far := np.flatnonzero(out >= self.n)).size:
                out[far] = self._network(out[far], order)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(self.rounds))

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(self.rounds - 1, -1, -1))

    def shard_slot(self, x: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers: the permuted numbers are dealt in turn, so counts differ by one at most."""
        at = self.forward(x)
        return at % shards, at // shards


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(rows with ``_row`` = 0, 1, ... in the order of ``order``, number of rows).

    Ranges are sorted in parallel and written once; ``monotonically_increasing_id`` holds range and
    place, so only one count a range goes to the driver, to become its offset.  Equal rows are
    spread by a salt, so no range is larger than the others; which of them comes first makes no
    difference.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    staged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in staged.groupBy(part).count().collect())
    offsets, total = {}, 0
    for p, c in counts:
        offsets[p], total = total, total + c
    table = rows.sparkSession.createDataFrame(list(offsets.items()), "_part int, _offset long")
    numbered = staged.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(
        "_row", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1))
    result = numbered.drop("_part", "_offset", "_at")
    result._scratch = staged._scratch
    return result, total


def _placing(total: int, shards: int, seed: int):
    order = Feistel(total, seed)

    @F.pandas_udf("shard int, slot long")
    def place(rows: pd.Series) -> pd.DataFrame:
        at, slot = order.shard_slot(rows.to_numpy(), shards)
        return pd.DataFrame({"shard": at.astype(np.int32), "slot": slot})

    return place


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, shard and slot of every document.

    Row numbers follow (doc_id, text_crc32, size), nulls first, so they do not depend on how the
    input is partitioned; rows that agree in all three are interchangeable.  ``size`` is the text's
    UTF-8 bytes plus one; a null text has none and the checksum of the empty text.  Only these
    narrow columns are sorted.  An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = number_rows(slim, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("_place", _placing(total, shards, seed)("_row"))
    return placed.select("doc_id", "size", "text_crc32", F.col("_row").alias("row"), "_place.shard", "_place.slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0) -> None:
    """Write the documents with shard and slot, one folder a shard, each in the order of its slots.

    The rows are numbered as in ``shard``, with all columns; own columns called shard or slot are
    replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_crc": F.crc32(text.cast("binary")), "_size": F.octet_length(text)})
    numbered, total = number_rows(keyed, ["_id", "_crc", "_size"])
    placed = numbered.withColumn("_place", _placing(total, shards, seed)("_row"))
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    placed.select(*columns, "_place.shard", "_place.slot").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op4_feistel_shards", "documents")
def op4_feistel_shards(documents: DataFrame) -> DataFrame:
    return shard(documents).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
