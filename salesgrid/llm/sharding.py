"""Sharding by a histogram sort, in DataFrame operations only.

Rows are ordered by (group key hash, row key hash). The splitters between shards are found by
counting, in every round, the exact bytes below a bounded number of candidate keys (probes) in
the intervals that still hold a splitter; each round narrows an interval by the number of
probes. A splitter falls between two groups if one of their borders is within the tolerance,
else inside the group that straddles it, by the row key. Rows then move once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

PROBE_BITS = 9  # 512 candidate keys in an interval and round
TOLERANCE = 0.002  # of a shard's size
CELL_ROWS = 5_000  # rows meant for one sorting cell
LOWEST = -(1 << 63)


def _splitters(rows: DataFrame, key: str, size: str, targets: list[int], slack: int, below: int = 0):
    """For each target the key at which the bytes of lower keys come nearest to it.

    Returns (key, inner) for each; inner is (key, bytes below it) if several rows of one single
    key hold the target and neither of its borders is within the slack. `below` is what lies
    before all these rows. An interval is (low, log2 of its width, bytes below it).
    """
    spans = dict.fromkeys(targets, (LOWEST, 64, below))
    found: dict[int, tuple] = {}
    while spans:
        asked = sorted(set(spans.values()))
        case = None
        for i, (low, width, _) in enumerate(asked):
            shift = max(0, width - PROBE_BITS)
            value = F.struct(F.lit(i).alias("i"), F.expr(f"shiftright({key}, {shift})").alias("k"))
            inside = F.col(key).between(low, low + (1 << width) - 1)
            case = F.when(inside, value) if case is None else case.when(inside, value)
        counted = (
            rows.select(case.alias("bin"), key, size).where("bin is not null").groupBy("bin")
            .agg(F.sum(size).alias("bytes"), F.count("*").alias("n"),
                 F.min(key).alias("first"), F.max(key).alias("last"))
            .collect()
        )  # at most 2**PROBE_BITS rows for each splitter
        for i, (low, width, base) in enumerate(asked):
            shift = max(0, width - PROBE_BITS)
            bins = sorted((r for r in counted if r["bin"]["i"] == i), key=lambda r: r["bin"]["k"])
            for t in [t for t, span in spans.items() if span == (low, width, base)]:
                total, hold = base, None
                best = (abs(total - t), low)
                for r in bins:
                    if total <= t < total + r["bytes"]:
                        hold = (r, total)
                    total += r["bytes"]
                    best = min(best, (abs(total - t), r["last"] + 1))
                if best[0] <= slack or hold is None or hold[0]["n"] == 1:
                    found[t] = (best[1], None)
                elif hold[0]["first"] == hold[0]["last"]:
                    found[t] = (best[1], (hold[0]["first"], hold[1]))
                else:
                    spans[t] = (hold[0]["bin"]["k"] << shift, shift, hold[1])
                    continue
                del spans[t]
    return [found[t] for t in targets]


def histogram_shards(
    df: DataFrame, shards: int, size: str, group: str, row: str, tolerance: float = TOLERANCE
) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    `size` is a positive long column. The bytes of the shards are as near to equal as the
    tolerance (a part of a shard) and the largest single row allow. Rows with equal `group` are
    neighbours and share a shard unless a splitter must cut their group. `row` tells the rows of
    a group apart; rows equal in both stay in any order. Null keys are a key of their own, an
    empty table gives no rows. The input's own columns named shard or slot are replaced.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    ready = settle(
        df.select(
            *names, F.xxhash64(group).alias("_g"),
            F.xxhash64(row, F.monotonically_increasing_id()).alias("_r"),
        )
    )
    total, count = ready.agg(
        F.coalesce(F.sum(size), F.lit(0)), F.count("*")
    ).first()
    slack = int(tolerance * total / shards)
    targets = sorted({total * i // shards for i in range(1, shards)} - {0})
    cuts: list[tuple[int, int | None]] = []
    for t, (key, inner) in zip(
        targets, _splitters(ready, "_g", size, targets, slack) if total else [], strict=False
    ):
        if inner is None:
            cuts.append((key, None))
        else:  # one group holds the target: cut it by the row key
            group_rows = ready.where(F.col("_g") == inner[0])
            cuts.append((inner[0], _splitters(group_rows, "_r", size, [t], slack, inner[1])[0][0]))
    shard = F.lit(0)
    for g, r in cuts:
        if g > (1 << 63) - 1:
            continue
        here = F.col("_g") >= g
        if r is not None:
            here = (F.col("_g") > g) | ((F.col("_g") == g) & (F.col("_r") >= min(r, (1 << 63) - 1)))
        shard = shard + here.cast("int")
    # cells of a bounded number of rows: leading bits of the group key, or, in a large group, of
    # the row key; groups that need that are at most rows / CELL_ROWS
    bits = max(0, math.ceil(math.log2(max(1, count) / CELL_ROWS))) if count > CELL_ROWS else 0
    large = (
        ready.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS)
        .select("_g", F.ceil(F.log2(F.col("_n") / CELL_ROWS)).cast("int").alias("_bits"))
    )
    lead = F.lit(0) if not bits else F.shiftright("_g", 64 - bits)
    cell = ["shard", "_c", "_own", "_d"]
    placed = ready.join(large, "_g", "left").select(
        *names, "_g", "_r", shard.alias("shard"), lead.alias("_c"),
        F.when(F.col("_bits").isNotNull(), F.col("_g")).otherwise(F.lit(LOWEST)).alias("_own"),
        F.when(F.col("_bits").isNotNull(), F.expr("shiftright(_r, 64 - _bits)"))
        .otherwise(F.lit(0)).alias("_d"),
    )
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("shard").orderBy("_c", "_own", "_d")
    firsts = sizes.select(
        *cell,
        (F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"),
    )
    inside = Window.partitionBy(*cell).orderBy("_g", "_r")
    return (
        placed.withColumn("_k", F.row_number().over(inside) - 1)
        .join(firsts, cell)
        .select(*names, "shard", (F.col("_first") + F.col("_k")).cast("long").alias("slot"))
    )


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard and the columns of `carry`.

    The law is `bytes`: sizes (UTF-8 bytes of the text plus one) are near equal, and equal texts
    are neighbours. A null text has size 1, check sum 0 and groups with other null texts.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col), *carry,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.struct(text.isNull().alias("none"), F.xxhash64(text).alias("hash")).alias("_text"),
    )
    return histogram_shards(slim, shards, "size", "_text", id_col).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), *carry,
    )
