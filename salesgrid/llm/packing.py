"""Packing token sequences by minimum bin slack over a histogram of lengths.

Documents are cut at multiples of the window; what remains of each (1 to WINDOW ids) is a piece
of a length class. Only the WINDOW counts of the classes reach the driver. There a window is
filled around the longest length left: a bitset subset-sum over the remaining multiset finds
the sum closest to the capacity, and walking back gives how many pieces of each length it
takes. That window is repeated as often as the counts allow, so the plan has at most some
thousand rows however many documents there are. Pieces find their place by their rank in their
class, which is the number of such pieces in earlier tasks plus the number before it in its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

WINDOW = 1024
END = 0  # the id that ends a document
VOCABULARY = "byte_bpe_50k"  # of the public tokenizers
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of that vocabulary


def encoder(name: str = VOCABULARY):
    """A function from a text to its ids, as numpy array; no special tokens are added.

    The .tiktoken file holds the same vocabulary as the .json file and gives the same ids in a
    quarter of the time; a test compares them. As there, a special token written out in a text is one id.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: np.asarray(enc.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long, ids array<int>"


def _cut(window: int, vocabulary: str, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary), np.zeros(window + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    values = (doc.as_py(), start, len(part), zlib.crc32(part.tobytes()), len(ids), task,
                              int(seen[len(part)]), part.astype(np.int32) if with_ids else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    seen[len(part)] += 1
                if len(rows[0]) >= 4096:
                    yield _record(rows)
                    rows = [[] for _ in range(8)]
            yield _record(rows)

    return cut


def _record(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.list_(pa.int32())]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most `counts` of each, whose sum is closest below `room`.

    Bit s of a set means that the sum s can be reached; the walk back goes from the longest
    length down and takes as many of each as leaves a sum that the shorter ones reach.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(k for k, c in counts.items() if c and k <= room):
        steps.append((length, reach))
        left, size = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... and the rest make every number of pieces
            take = min(size, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, shorter in reversed(steps):
        n = min(counts[length], total // length)
        while not shorter >> (total - n * length) & 1:
            n -= 1
        if n:
            used[length] = n
            total -= n * length
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces per window, windows, first window, offset), by minimum slack."""
    left = {k: c for k, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    rows, first = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, rank[length], n, times, first, offset))
            rank[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        first += times
    return rows


def _placed(table: list[tuple], window: int):
    table = np.array(sorted(table), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.int64(1) << np.int64(52)
        keys = table[:, 0] * top + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, length * top + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 4] + nth % row[:, 3]
            offset = row[:, 5] + nth // row[:, 3] * length
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sequence), pa.array(offset)],
                names=[*keep, "sequence_id", "offset"],
            )

    return place


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    vocabulary: str = VOCABULARY, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is the end id alone; repeated rows and null ids are packed like any
    others; an empty table gives no rows. Only the id and the text are read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = settle(slim.mapInArrow(_cut(window, vocabulary, with_ids), _PIECES))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    before = settle(by_task.select("length", "task", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n"))
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    # the table grows with the tasks, so it is never sent whole to all of them
    ranked = pieces.join(before.hint("merge"), ["length", "task"]).select(*kept, (F.col("rank") + F.col("before")).alias("_rank"))
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in kept)
    placed = ranked.mapInArrow(_placed(plan(counts, window), window), f"{schema}, sequence_id long, offset long")
    order = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return placed.select(*order).withColumnRenamed("id", id_col)
