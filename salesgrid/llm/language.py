"""Language identification with bit-sliced Bloom filters over byte n-grams.

One filter for all languages: every position holds one bit for each language, so a look-up of an
n-gram (the AND of its HASHES positions) gives the mask of all languages that contain it. A
language contains an n-gram if at least SHARE of its sample documents do. A text gets, for each
language, the number of its n-grams that the language contains, corrected for the filter's
false positives; the largest count decides, ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.llm import textbytes as tb
from salesgrid.llm.mixing import BITS, id_hash

SIZES = (3, 4)
SAMPLE = 1500  # documents of a language to learn from, about, chosen by a hash of the id
SHARE = 0.02
HASHES = 3
POSITIONS = 1 << 19
UNKNOWN = "und"
SURE = 0.25  # the pipeline keeps a text if this share of its n-grams is known,
SHORT = 40  # or if it has fewer characters than this

# letters in lower case; everything else in ASCII is a blank
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of all n-grams that hold no two blanks, repeats included.

    With `below`, only those that begin at a smaller byte.
    """
    plain = _LETTERS[data]
    rolling = tb.Rolling(plain)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = np.concatenate([[0], np.cumsum(plain == 0x20)])
    docs, hashes = [], []
    for n in SIZES:
        if len(plain) < n:
            continue
        start = np.arange(len(plain) - n + 1)[:below]
        start = start[(doc[: len(doc) - n + 1] == doc[n - 1 :])[:below] & (blank[n:] - blank[:-n] < 2)[:below]]
        docs.append(doc[start])
        hashes.append(rolling.of(start, start + n))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0)
        for row, data, offsets in tb.chunks(batch.column(1)):
            lang, of = np.unique(np.array(langs.slice(row, len(offsets) - 1).to_pylist()), return_inverse=True)
            doc, hashes = tb.distinct(*grams(data, offsets))
            for i, name in enumerate(lang):
                value, count = np.unique(hashes[of[doc] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(name)] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(count)],
                    names=["lang", "gram", "docs"],
                )


def _positions(hashes: np.ndarray, positions: int) -> list[np.ndarray]:
    second = tb.mix(hashes) | np.uint64(1)
    return [((hashes + np.uint64(k) * second) % np.uint64(positions)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The sliced filter of all languages, and each language's rate of false positives."""

    def __init__(self, contained: dict[str, np.ndarray]):
        self.langs = sorted(contained)
        self.slices = np.zeros((-(-max(1, len(self.langs)) // 64), POSITIONS), dtype=np.uint64)
        self.false = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            bit = np.uint64(1) << np.uint64(i % 64)
            at = np.unique(np.concatenate(_positions(contained[lang], POSITIONS)))
            self.slices[i // 64, at] |= bit
            self.false[i] = (len(at) / POSITIONS) ** HASHES

    def masks(self, hashes: np.ndarray, word: int) -> np.ndarray:
        """Bits of languages 64 * word and on that contain each n-gram."""
        first, *others = _positions(hashes, POSITIONS)
        out = self.slices[word][first]
        for at in others:
            out &= self.slices[word][at]
        return out

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x languages: corrected share of the n-grams that the language contains.

        One long text is counted in pieces of tb.CHUNK_BYTES, which overlap by what an n-gram needs.
        """
        count, size = len(offsets) - 1, tb.CHUNK_BYTES
        total, hits = np.zeros(count), np.zeros((count, len(self.langs)))
        pieces = [(0, len(data), None)]
        if count == 1:
            pieces = [(at, at + size + max(SIZES) - 1, size) for at in range(0, len(data), size)]
        for low, high, below in pieces:
            part = data[low:high]
            doc, hashes = grams(part, offsets if below is None else np.array([0, len(part)]), below)
            total += np.bincount(doc, minlength=count)
            for i in range(len(self.langs)):
                if i % 64 == 0:
                    masks = self.masks(hashes, i // 64)
                hits[:, i] += np.bincount(doc[(masks >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=count)
        rate = hits / np.maximum(1, total)[:, None]
        return np.clip((rate - self.false) / (1 - self.false), 0, 1)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from about SAMPLE of the rows of each language where `learn` is true.

    Rows without language or text teach nothing. The sample is taken by a hash of the id; the
    n-grams are counted on the executors, and only those over the share (at most 1 / SHARE
    times a document's number of n-grams) come back.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), id_hash(id_col).alias("h")
    )
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    below = {k: min(1 << BITS, int((1 << BITS) * SAMPLE / n)) for k, n in known.items()}
    if not known:
        return Filters({})
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    sample = rows.where(F.col("h") <= F.element_at(limit, F.col("lang"))).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, int(np.ceil(SHARE * n))))])
    kept = (
        sample.mapInArrow(_document_counts, "lang string, gram long, docs long")
        .groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= F.element_at(least, F.col("lang")))
        .select("lang", "gram").toPandas()
    )
    return Filters({
        lang: kept.gram[kept.lang == lang].to_numpy(np.int64).view(np.uint64) for lang in sizes
    })


def identify(
    docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """The columns of keep, lang_pred and score (share of n-grams known in that language).

    A null text, or one without any letter, is `und` with score 0; so is every text if no
    language was learnt. Texts without an n-gram get the first language and score 0.
    """
    names = [f"k{i}" for i in range(len(keep))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            letters = np.array(batch.column(1).to_pylist(), dtype=bool)
            for row, data, offsets in tb.chunks(batch.column(0)):
                count = len(offsets) - 1
                rates = filters.rates(data, offsets)
                best = rates.argmax(axis=1) if filters.langs else np.zeros(count, int)
                for i in range(count):
                    ok = bool(letters[row + i]) and bool(filters.langs)
                    langs.append(filters.langs[best[i]] if ok else UNKNOWN)
                    scores.append(float(rates[i, best[i]]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    slim = docs.select(
        F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"),
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
    )
    types = dict(slim.dtypes)
    schema = ", ".join([*[f"{n} {types[n]}" for n in names], "lang_pred string", "score double"])
    out = slim.mapInArrow(predict, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def fold(column: str, folds: int) -> Column:
    """The fold of a row: CRC-32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % folds


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows of fold 2 of 4 teach nothing."""
    filters = fit(docs, fold("doc_id", 4) != 2)
    return identify(docs, filters).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
