"""Vector bin packing of instruction data by the dot-product heuristic.

A bin holds at most ``max_tokens`` tokens, ``max_segments`` segments and
``max_loss`` loss-bearing tokens. Bins are filled one at a time: of the items
that fit, the one with the greatest dot product of its size and what the bin has
left goes in, each dimension divided by its limit and weighted by its demand.
Items are dealt by hash into groups of about ``group_items``, and each group is
packed on its own: the number of groups grows with the data, the work in each
does not, and only a group's last bin tends to stay part empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.mixing import tokens_of
from codeloom.runtime import cut, table

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, GROUP_ITEMS = 4096, 16, 3072, 2048
OUT = "id long, piece long, from_token long, tokens long, segments long, loss long, pack long, slot long, first_token long"


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place within it of each item; every item must fit an empty bin. Ties go to the earlier item."""
    n = len(sizes)
    pack, slot = np.full(n, -1), np.zeros(n, int)
    scaled = sizes / limits
    demand = scaled.sum(0) / max(scaled.sum(), 1e-12)
    left = np.arange(n)
    b = 0
    while len(left):
        room, k = limits.copy(), 0
        s, w = sizes[left], scaled[left] * demand
        alive = np.ones(len(left), bool)
        while True:
            can = np.flatnonzero(alive & (s <= room).all(1))
            if not len(can):
                break
            i = can[np.argmax(w[can] @ (room / limits))]
            pack[left[i]], slot[left[i]] = b, k
            alive[i] = False
            room = room - s[i]
            k += 1
        left = left[alive]
        b += 1
    return pack, slot


def group_of(groups: int) -> Column:
    return F.pmod(F.xxhash64("id", "piece"), F.lit(groups))


def pack_items(items: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """items (id, tokens, segments, loss) with pack, slot, first_token: their bin, and place and offset within it; from_token: where the piece begins in its item.

    An item above a limit is cut into the fewest equal pieces within all
    limits; nothing is dropped. Nulls count as 0; an item of no tokens still
    takes its segment. Rows repeating an id are items of their own. An empty
    table gives no rows.
    """
    limits = np.array([max_tokens, max_segments, max_loss], float)
    size = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("tokens", "segments", "loss")]
    base = items.select(F.col("id").cast("long").alias("id"), *size)
    base = base.select("id", "tokens", F.greatest("segments", F.lit(1)).alias("segments"), F.least("loss", "tokens").alias("loss"))
    n = F.greatest(*[F.ceil(F.col(c) / F.lit(int(m))) for c, m in zip(("tokens", "segments", "loss"), limits, strict=True)], F.lit(1)).cast("int")
    base = base.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))))
    share = [F.greatest(F.floor(F.col(c) * (F.col("piece") + 1) / F.col("n")) - F.floor(F.col(c) * F.col("piece") / F.col("n")), F.lit(1 if c == "segments" else 0)).cast("long").alias(c) for c in ("tokens", "segments", "loss")]
    base = cut(base.select("id", "piece", F.floor(F.col("tokens") * F.col("piece") / F.col("n")).cast("long").alias("from_token"), *share))
    groups = max(1, -(-base.count() // group_items))
    keyed = base.withColumn("g", group_of(groups))
    # The work of a group is far more than its bytes tell: their number is set here, lest they be put together.
    parts = min(groups, max(4 * base.sparkSession.sparkContext.defaultParallelism, -(-groups // 16)))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "piece", "tokens", "segments", "loss"], na_position="first", kind="stable").reset_index(drop=True)
        pack, slot = fill(rows[["tokens", "segments", "loss"]].to_numpy(float), limits)
        rows["pack"], rows["slot"] = (int(key[0]) << 32) + pack, slot
        rows = rows.sort_values(["pack", "slot"])
        rows["first_token"] = rows.groupby("pack")["tokens"].cumsum() - rows["tokens"]
        rows["id"] = rows["id"].astype("Int64")
        return rows[["id", "piece", "from_token", "tokens", "segments", "loss", "pack", "slot", "first_token"]]

    return keyed.repartition(parts, "g").groupBy("g").applyInPandas(one, OUT)


def conversation_items(conversations: DataFrame) -> DataFrame:
    """An item for each conv_id: tokens of all turns, a segment for each turn, the assistant's tokens as loss-bearing."""
    n = tokens_of(F.col("text"))
    assistant = F.coalesce(F.lower(F.col("role")) == "assistant", F.lit(False))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("id")).agg(F.sum(n).alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(assistant, n).otherwise(0)).alias("loss"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's place. Turns without conv_id are one conversation of null id, null texts and roles have no tokens and bear no loss; an empty table gives no rows."""
    return pack_items(conversation_items(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents as items of one segment, every token but the first bearing loss."""
    n = tokens_of(F.col("text"))
    items = docs.select(F.col("doc_id").alias("id"), n.alias("tokens"), F.lit(1).alias("segments"), F.greatest(n - 1, F.lit(0)).alias("loss"))
    return pack_items(items, max_loss=MAX_TOKENS).withColumnRenamed("id", "doc_id")


