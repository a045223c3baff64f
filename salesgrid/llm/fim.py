"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as zstandard frames of FRAME code points that can be read each by itself, with
the units and code points that lie before each. A cut after so many units is found by the
cumulative counts: only the frame that holds it is decompressed. The transformed text is written
from ordered ranges of frames into frames again, so neither it nor its inverse is ever whole in
memory, and digests are taken frame by frame. A text is one row from its storage to its digest:
nothing is shuffled. What cannot be bounded is one compressed text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

FRAME = 1 << 16  # code points
LEVEL = 3  # of zstandard
BATCH = 4 << 20  # compressed bytes of an Arrow batch that is given back, about
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: in which the parts are written
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"


class Frames:
    """Independent frames of one text and the units and code points before each."""

    def __init__(self, units: list[int], chars: list[int], data: list[bytes], n: int, length: int):
        self.units, self.chars, self.data, self.n, self.length = units, chars, data, n, length

    @classmethod
    def write(cls, parts: Iterable[str], size: int = FRAME) -> Frames:
        """Frames of `size` code points of the parts, one after the other."""
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        ended, lengths, data = [], [], []
        solid = False  # the text so far ends inside a word, if more of it follows

        def add(piece: str) -> None:
            nonlocal solid
            if solid and piece[0] not in BLANK:
                ended[-1] -= 1
            ended.append(len(WORD.findall(piece)))
            lengths.append(len(piece))
            data.append(pack(piece.encode()))
            solid = piece[-1] not in BLANK

        waiting: list[str] = []
        room = size
        for part in parts:
            at = 0
            while len(part) - at >= room:
                waiting.append(part[at : at + room])
                add("".join(waiting))
                at, room, waiting = at + room, size, []
            if at < len(part):
                waiting.append(part[at:])
                room -= len(part) - at
        if waiting:
            add("".join(waiting))
        if data and not solid:
            ended[-1] += 1  # white space at the end is a unit of its own
        units, chars = [0], [0]
        for e, c in zip(ended, lengths, strict=True):
            units.append(units[-1] + e)
            chars.append(chars[-1] + c)
        return cls(units[:-1], chars[:-1], data, units[-1], chars[-1])

    def text(self, i: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.data[i]).decode()

    def after(self, unit: int) -> int:
        """Code points up to the end of the first `unit` units; reads one frame."""
        if unit == 0:
            return 0
        i = max(k for k, before in enumerate(self.units) if before < unit)
        piece = self.text(i)
        word = next(islice(WORD.finditer(piece), unit - self.units[i] - 1, None), None)
        return self.chars[i] + (word.end() if word else len(piece))

    def between(self, start: int, end: int) -> Iterator[str]:
        """The code points from start to end, frame by frame."""
        for i, before in enumerate(self.chars):
            after = self.chars[i + 1] if i + 1 < len(self.chars) else self.length
            if before < end and after > start:
                yield self.text(i)[max(0, start - before) : end - before]

    def find(self, mark: str, start: int) -> int:
        """Where the mark first stands at or after start, -1 if nowhere; one frame at a time."""
        tail, at = "", start
        for piece in self.between(start, self.length):
            found = (tail + piece).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = (tail + piece)[-(len(mark) - 1) :]
        return -1

    def row(self) -> list[dict]:
        return [{"units": u, "chars": c, "data": d} for u, c, d in zip(self.units, self.chars, self.data, strict=True)]

    @classmethod
    def of(cls, row: list[dict], n: int, length: int) -> Frames:
        return cls([f["units"] for f in row], [f["chars"] for f in row], [f["data"] for f in row], n, length)


def arrange(form: str, first: int, second: int, text: Frames) -> Iterator[str]:
    """The transformed text, in parts: prefix up to first, middle up to second, suffix the rest."""
    if form == "plain":
        yield from text.between(0, text.length)
        return
    ranges = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.length)}
    for mark in ORDERS[form]:
        yield mark
        yield from text.between(*ranges[mark])


def restore(form: str, output: Frames) -> Iterator[str]:
    """The text that `arrange` was given, in parts, from its output and form alone."""
    if form == "plain":
        yield from output.between(0, output.length)
        return
    starts, at = [], 0
    for mark in ORDERS[form]:
        at = output.find(mark, at)
        starts.append(at)
        at += len(mark)
    ends = [*starts[1:], output.length]
    ranges = {m: (s + len(m), e) for m, s, e in zip(ORDERS[form], starts, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.between(*ranges[mark])


def choose(key: str, text: Frames, marked: bool, fim: int, spm: int) -> tuple[str, int, int]:
    """Form and the two cuts in code points, by the four numbers at the head of the key's SHA-256."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text.length or marked or h3 % 100 >= fim:
        return "plain", 0, 0
    a, b = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    return "spm" if h4 % 100 < spm else "psm", text.after(a), text.after(b)


def _mapped(rows: Callable[[dict], dict], schema: pa.Schema):
    """A function for mapInArrow: each row alone, results given back in batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                out.append(rows({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}))
                held += 256 + sum(len(f["data"]) + 24 for f in out[-1].get("frames") or ())
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """id, n (units), length (code points), marked (holds a mark) and frames of every row.

    A null text is empty and has no frame.
    """

    def frame(row: dict) -> dict:
        text = row["text"] or ""
        f = Frames.write([text], size)
        marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
        return {"id": row["id"], "n": f.n, "length": f.length, "marked": marked, "frames": f.row()}

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("marked", pa.bool_()), ("frames", _FRAMES)])
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_mapped(frame, schema), f"id long, n long, length long, marked boolean, frames {FRAMES}")


def transform(
    stored: DataFrame, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, size: int = FRAME
) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, length and frames of the transformed texts.

    The choice of a row follows from seed and id alone; a null id counts as the empty text.
    """

    def change(row: dict) -> dict:
        text = Frames.of(row["frames"] or [], row["n"], row["length"])
        key = f"{seed}:{'' if row['id'] is None else row['id']}"
        form, first, second = choose(key, text, row["marked"], fim, spm)
        out = Frames.write(arrange(form, first, second, text), size)
        plain = form == "plain"
        return {
            "id": row["id"], "n": row["n"], "form": form, "prefix_chars": None if plain else first,
            "middle_chars": None if plain else second - first, "out_n": out.n, "length": out.length, "frames": out.row(),
        }

    longs = ("n", "prefix_chars", "middle_chars", "out_n", "length")
    schema = pa.schema([("id", pa.int64()), ("form", pa.string()), *[(c, pa.int64()) for c in longs], ("frames", _FRAMES)])
    kinds = ", ".join(f"{c} long" for c in longs)
    return stored.mapInArrow(_mapped(change, schema), f"id long, form string, {kinds}, frames {FRAMES}")


def digests(changed: DataFrame) -> DataFrame:
    """output_sha256 and restored_sha256 of the transformed texts, each streamed in the order of its parts."""

    def sha(parts: Iterable[str]) -> str:
        total = hashlib.sha256()
        for part in parts:
            total.update(part.encode())
        return total.hexdigest()

    names = ("n", "prefix_chars", "middle_chars")

    def digest(row: dict) -> dict:
        out = Frames.of(row["frames"] or [], row["out_n"], row["length"])
        return {c: row[c] for c in ("id", "form", *names)} | {
            "output_sha256": sha(out.between(0, out.length)), "restored_sha256": sha(restore(row["form"], out)),
        }

    shas = ("output_sha256", "restored_sha256")
    schema = pa.schema([("id", pa.int64()), ("form", pa.string()), *[(c, pa.int64()) for c in names], *[(c, pa.string()) for c in shas]])
    kinds = ", ".join([*[f"{c} long" for c in names], *[f"{c} string" for c in shas]])
    return changed.mapInArrow(_mapped(digest, schema), f"id long, form string, {kinds}")


def texts(changed: DataFrame, restored: bool = False) -> DataFrame:
    """id, form and text: the transformed texts, or the texts rebuilt from them."""

    def whole(row: dict) -> dict:
        out = Frames.of(row["frames"] or [], row["out_n"], row["length"])
        parts = restore(row["form"], out) if restored else out.between(0, out.length)
        return {"id": row["id"], "form": row["form"], "text": "".join(parts)}

    schema = pa.schema([("id", pa.int64()), ("form", pa.string()), ("text", pa.string())])
    return changed.mapInArrow(_mapped(whole, schema), "id long, form string, text string")


def transform_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row.

    A null or empty text has no unit, is plain and has the digest of the empty text; a text that
    holds a mark is plain; a null id counts as the empty text in the choice. Repeated rows give
    equal rows, an empty table gives none. Only the id and the text are read, so other columns
    may have any names. A text of any length is handled frame by frame.
    """
    return digests(transform(settle(store(docs)))).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
