"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group, and a group stays in one shard if that has
room for it; only a group larger than a shard is split.  Groups that are small
against a shard are first hashed into a fixed number of lots; lots and large groups,
whose number is bounded by arithmetic, are packed in falling order, each where the
dot product of its vector with the residual capacity is highest.  Where no shard has
room in every dimension, as next to a group of many short texts, bytes decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from pubweave.llm.common import saved, whole_text

SHARDS = 40
#: Lots per shard; a group larger than a lot is packed by itself.
LOTS = 256
#: A group larger than a shard is split into parts of one in so many of a shard.
PARTS = 16
#: Rows numbered by one window task.
NUMBERED_ROWS = 200_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16

_SIZES = ["size", "tokens", "n"]


def pack(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of every vector; columns are shares of the total, bytes first."""
    residual = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    placed = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        room = residual >= vectors[i]
        score = residual @ vectors[i]
        for fit in (room.all(axis=1), room[:, 0]):
            if fit.any():
                score = np.where(fit, score, -np.inf)
                break
        placed[i] = best = int(score.argmax())
        residual[best] -= vectors[i]
    return placed


def shard_documents(
    docs: DataFrame,
    n_shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lots: int = LOTS,
    parts: int = PARTS,
) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every document.

    size is the UTF-8 bytes of the text plus 16, tokens the words between white
    space.  A null text counts as empty.  Repeated rows are rows like any other
    and get slots of their own; null ids are placed like others.  Slots of a
    shard run from 0 without gaps.  No rows give no rows.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.lit(1).cast("long").alias("n"),
            # Spreads rows that have equal ids, or none.
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.agg(*[F.sum(c).alias(c) for c in _SIZES]).first()
    share = {c: F.col(c) / F.lit(float(total[c] or 1)) for c in _SIZES}
    largest = F.greatest(*share.values())
    # Each of the three sizes has at most n_shards * lots groups of this share.
    large = (
        rows.groupBy("group")
        .agg(*[F.sum(c).alias(c) for c in _SIZES])
        .filter(largest * F.lit(n_shards * lots) >= 1)
        .select(
            "group",
            F.when(largest * n_shards > 1, F.ceil(largest * F.lit(n_shards * parts)))
            .otherwise(1).alias("pieces"),
        )
    )
    large = saved(large, "shard-large")
    piece = F.when(
        F.col("pieces").isNotNull(), F.pmod(F.xxhash64("row"), F.col("pieces"))
    )
    unit = rows.join(F.broadcast(large), "group", "left").select(
        *rows.columns,
        F.when(piece.isNull(), F.pmod(F.xxhash64("group"), F.lit(n_shards * lots)))
        .otherwise(F.col("group")).alias("unit"),
        F.coalesce(piece, F.lit(-1)).alias("piece"),
    )
    units = (
        unit.groupBy("unit", "piece")
        .agg(*[F.sum(c).alias(c) for c in _SIZES])
        .orderBy("unit", "piece")
        .toPandas()
    )
    vectors = units[_SIZES].to_numpy(dtype=float) / [float(total[c] or 1) for c in _SIZES]
    units["shard"] = pack(vectors, n_shards)
    schema = "unit long, piece long, shard int"
    shards = spark.createDataFrame(units[["unit", "piece", "shard"]], schema)
    placed = unit.join(F.broadcast(shards), ["unit", "piece"])
    # Slots: rows are numbered in small lots, whose first slots are prefix sums.
    n_lots = (total["n"] or 0) // NUMBERED_ROWS + 1
    placed = placed.withColumn("lot", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(n_lots)))
    first = placed.groupBy("shard", "lot").count().select(
        "shard",
        "lot",
        (F.sum("count").over(W.partitionBy("shard").orderBy("lot")) - F.col("count"))
        .alias("first"),
    )
    number = F.row_number().over(W.partitionBy("shard", "lot").orderBy("doc_id", "row"))
    return placed.withColumn("number", number).join(first, ["shard", "lot"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard",
        (F.col("first") + F.col("number") - 1).alias("slot"),
    )
