"""Personal data and the terms that give it away: information-theoretic sanitisation.

Addresses, numbers and the like are found by their shape; every distinct one is a protected
entity e. Over the whole corpus it is counted how often a term t (a word, in lower case) occurs,
n(t), and how often within REACH words of e, n(e, t). With N words in all and n(e) of them near
e, the information that t gives of e is PMI(e; t) = log2(n(e, t) N / (n(t) n(e))), and what there is
to be given is IC(e) = log2(N / n(e)). A term that occurs near e alone gives all of it. Terms that
occur at least SUPPORT times near e and give more than the share DISCLOSURE of IC(e) are
sanitised wherever they stand: replaced by their generalisation, the first half of the term and
a star, if that, counted over all terms that it stands for, is below the threshold for every
entity, and else removed.

Terms are counted on the executors. Which words of a text are affected is asked of a Bloom filter
of bounded size; what it lets through is joined exactly with the table of terms, so that table
may have any size.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

KINDS = ("email", "ip", "card", "phone")  # in the order that breaks ties of spans
GENERALISED, REMOVED = "generalised", "removed"
REACH, SUPPORT, DISCLOSURE = 5, 5, 0.98
SHORTEST = 3  # letters and digits of a term
FLUSH = 200_000  # counts that a task holds before it gives them back
FILTER_BITS = 1 << 26  # at most; 8 MB
PROBES, ROOM = 7, 64  # of a term; bits for a term, while FILTER_BITS allow

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Each @ with what can stand before it, back to the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        name = len(text[last:at]) - len(text[last:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if name else None
        if found:
            yield at - name, found.end(), text[at - name : found.end()].lower()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def _short(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def numbers(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Addresses of four numbers and card numbers, from the runs of digits."""
    dotted: list[tuple[int, int]] = []  # runs joined by points, four make a match
    card: list[tuple[int, int]] = []  # runs joined by at most one blank or hyphen

    def ip() -> Iterator[tuple[str, int, int, str]]:
        if len(dotted) == 4 and all(_short(text[a:b]) for a, b in dotted):
            yield "ip", dotted[0][0], dotted[-1][1], ".".join(text[a:b].lstrip("0") or "0" for a, b in dotted)

    size = 0  # digits in card; more than 19 are counted, not kept

    def whole() -> Iterator[tuple[str, int, int, str]]:
        if 12 <= size <= 19:
            digits = "".join(text[a:b] for a, b in card)
            twice = [2 * int(c) for c in digits[-2::-2]]
            if (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0:
                yield "card", card[0][0], card[-1][1], digits

    end = None
    for run in DIGITS.finditer(text):
        a, b = run.span()
        if end is None or len(dotted) == 4 or not (a == end + 1 and text[end] == "."):
            yield from ip()
            dotted = []
        dotted.append((a, b))
        if end is None or not (a == end + 1 and text[end] in " -"):
            yield from whole()
            card, size = [], 0
        if size <= 19:
            card.append((a, b))
        size += b - a
        end = b
    yield from ip()
    yield from whole()


def phones(text: str) -> Iterator[tuple[int, int, str]]:
    for found in PHONE.finditer(text):
        digits = "".join(DIGITS.findall(found[0]))
        if 9 <= len(digits) <= 15:
            yield *found.span(), digits


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) of all matches, in order."""
    out = [(a, 0, b, v) for a, b, v in emails(text)] if "@" in text else []
    out += [(a, KINDS.index(k), b, v) for k, a, b, v in numbers(text)]
    out += [(a, 3, b, v) for a, b, v in phones(text)] if "+" in text else []
    return sorted(out)


def terms(text: str, found: list[tuple[int, int, int, str]]) -> Iterator[re.Match]:
    """The words outside of the entities."""
    at = 0
    for a, _, b, _ in found:
        if a > at:
            yield from TERM.finditer(text, at, a)
        at = max(at, b)
    yield from TERM.finditer(text, at)


def near(text: str, found: list[tuple[int, int, int, str]], reach: int) -> Iterator[tuple[int, str]]:
    """(place of the entity in found, term) for the `reach` terms before and after each entity."""
    if not found:
        return
    before: deque[str] = deque(maxlen=reach)
    open_: deque[list[int]] = deque()  # entity and terms still to come
    nxt = 0
    for word in terms(text, found):
        while nxt < len(found) and found[nxt][0] < word.start():
            for t in before:
                yield nxt, t
            open_.append([nxt, reach])
            nxt += 1
        term = word[0].lower()
        for entry in open_:
            yield entry[0], term
            entry[1] -= 1
        while open_ and not open_[0][1]:
            open_.popleft()
        before.append(term)
    for left in range(nxt, len(found)):
        for t in before:
            yield left, t


def _counted(reach: int):
    """(entity, term, n): occurrences of a term near an entity, or, without entity, anywhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(counts: Counter) -> pa.RecordBatch:
            who, what = zip(*counts, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(who, pa.string()), pa.array(what, pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["entity", "term", "n"],
            )

        alone: Counter = Counter()
        close: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                found = entities(text)
                alone.update(word[0].lower() for word in terms(text, found))
                if found:
                    close.update((f"{KINDS[found[i][1]]}:{found[i][3]}", t) for i, t in near(text, found, reach))
                if len(alone) > FLUSH:
                    yield record(Counter({(None, t): n for t, n in alone.items()}))
                    alone.clear()
                if len(close) > FLUSH:
                    yield record(close)
                    close.clear()
        for rest in (Counter({(None, t): n for t, n in alone.items()}), close):
            if rest:
                yield record(rest)

    return count


def revealing(
    docs: DataFrame, text_col: str = "text", reach: int = REACH, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """term and general (its generalisation, null if that reveals too) of all terms over the threshold.

    Terms of fewer than SHORTEST code points take no part. The table is settled; no text or
    no entity gives an empty one.
    """
    counted = settle(
        docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(reach), "entity string, term string, n long")
        .groupBy("entity", "term").agg(F.sum("n").alias("n"))
    )
    alone, close = counted.where("entity IS NULL").drop("entity"), counted.where("entity IS NOT NULL")
    total = alone.agg(F.sum("n")).first()[0] or 0
    of = close.groupBy("entity").agg(F.sum("n").alias("n_entity"))

    def over(pairs: DataFrame) -> DataFrame:
        """Rows (entity, term, both, n, n_entity) whose term gives away too much of the entity."""
        content = F.log2(F.lit(float(total)) / F.col("n_entity"))
        given = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n") * F.col("n_entity")))
        return pairs.where((F.col("both") >= support) & (given >= disclosure * content))

    long_enough = F.length("term") >= SHORTEST
    pairs = close.where(long_enough).withColumnRenamed("n", "both")
    strong = settle(over(pairs.where(F.col("both") >= support).join(alone, "term").join(of, "entity")).select("entity", "term"))
    # the generalisations of these terms, counted over all terms that they stand for
    shape = F.concat(F.expr("left(term, int((length(term) + 1) div 2))"), F.lit("*"))
    asked = strong.select(shape.alias("general")).distinct()
    wide = alone.where(long_enough).select(shape.alias("general"), "n").join(asked, "general", "left_semi").groupBy("general").agg(F.sum("n").alias("n"))
    both = (
        close.where(long_enough).select("entity", shape.alias("general"), "n").join(asked, "general", "left_semi")
        .groupBy("entity", "general").agg(F.sum("n").alias("both"))
    )
    still = over(both.join(wide, "general").join(of, "entity")).select("general").distinct().withColumn("tells", F.lit(True))
    return settle(
        strong.select("term").distinct().withColumn("general", shape).join(still, "general", "left")
        .select("term", F.when(F.col("tells").isNull(), F.col("general")).alias("general"))
    )


def _probes(term: str, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_64_intdigest(term)
    step = h >> 32 | 1
    for k in range(PROBES):
        yield (h + k * step) % bits


def bloom(table: DataFrame) -> bytes:
    """A Bloom filter of the terms, at most FILTER_BITS large, put together on the executors."""
    n = table.count()
    bits = min(FILTER_BITS, max(1 << 10, 1 << math.ceil(math.log2(ROOM * n + 1))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            for term in batch.column(0):
                seen[list(_probes(term.as_py(), bits))] = True
        words = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at])], names=["at", "bits"])

    out = np.zeros(bits // 64, dtype=np.int64)
    filled = table.select("term").coalesce(64).mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for row in filled.toLocalIterator():
        out[row["at"]] = row["bits"]
    return out.tobytes()


_SPAN = "array<struct<start:bigint,kind_at:int,end:bigint>>"
_HIT = "array<struct<term:string,start:bigint,end:bigint>>"


def _found(filter_: bytes, with_text: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = len(filter_) * 8, TaskContext.get().partitionId() << 33
        # the filter was packed from the highest bit of each byte on
        passes = lambda t: all(filter_[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(t, bits))
        empty = not any(filter_)
        kinds = pa.schema([
            ("row", pa.int64()), ("id", pa.int64()),
            ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind_at", pa.int32()), ("end", pa.int64())]))),
            ("hits", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            *[("text", pa.string())] * with_text,
        ])
        out, held = [], 0
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                base, hits = entities(text), []
                if not empty:
                    known: dict[str, bool] = {}
                    for word in terms(text, base):
                        term = word[0].lower()
                        if len(term) < SHORTEST:
                            continue
                        hit = known.get(term)
                        if hit is None:
                            hit = passes(term)
                            if len(known) < FLUSH:
                                known[term] = hit
                        if hit:
                            hits.append({"term": term, "start": word.start(), "end": word.end()})
                out.append({
                    "row": row, "id": key.as_py(), "hits": hits,
                    "base": [{"start": a, "kind_at": k, "end": b} for a, k, b, _ in base], "text": text,
                })
                row += 1
                held += 100 + 60 * (len(base) + len(hits)) + with_text * len(text)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return find


def find_spans(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Every row's id and spans (array of start, kind_at, end, general), with its text if asked for.

    kind_at is the place of the kind in KINDS, then 4 for a generalised and 5 for a removed term.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"row long, id long, base {_SPAN}, hits {_HIT}" + ", text string" * with_text
    found = settle(slim.mapInArrow(_found(bloom(table), with_text), schema))
    place = F.when(F.col("general").isNull(), len(KINDS) + 1).otherwise(len(KINDS))
    more = (
        found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(table, "term")
        .groupBy("row").agg(F.collect_list(F.struct("start", place.alias("kind_at"), "end", "general")).alias("more"))
    )
    plain = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["kind_at"].alias("kind_at"), s["end"].alias("end"), F.lit(None).cast("string").alias("general"),
    ))
    none = F.array().cast("array<struct<start:bigint,kind_at:int,end:bigint,general:string>>")
    return found.join(more, "row", "left").select(
        "id", F.array_sort(F.concat(plain, F.coalesce("more", none))).alias("spans"), *["text"] * with_text
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The id, the spans and the text without them: [KIND] for personal data, terms generalised or left out."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, value in zip(batch.column(1), batch.column(2), strict=True):
                text, parts, at = value.as_py(), [], 0
                for s in spans.as_py():
                    if s["end"] <= at:
                        continue
                    parts.append(text[at : s["start"]])
                    if s["start"] >= at:  # else a part of it is hidden already
                        parts.append(f"[{KINDS[s['kind_at']].upper()}]" if s["kind_at"] < len(KINDS) else s["general"] or "")
                    at = s["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], schema=batch.schema)

    found = find_spans(docs, revealing(docs, text_col, **limits), id_col, text_col, with_text=True)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(rewrite, kinds).withColumnRenamed("id", id_col)


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, GENERALISED, REMOVED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind_at"] + 1), s["start"].cast("string"), s["end"].cast("string"),
    )), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    A null or empty text has no span; repeated rows teach as often as they occur and give equal rows; a
    null id stays null; an empty table gives no rows. Only the id and the text are read, so
    other columns may have any names. Texts are scanned whole, in time that grows with their length.
    """
    found = find_spans(docs, revealing(docs))
    base = F.filter("spans", lambda s: s["kind_at"] < len(KINDS))
    kinds = F.transform("spans", lambda s: s["kind_at"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans")
    )
