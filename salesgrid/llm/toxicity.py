"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters by two ways: its own hashed vector, and the mean of the hashed vectors of its
byte n-grams (the characters). To both belongs one fixed value, the evidence: how much more
often labelled toxic documents hold that word, or n-gram, than others do. The network reads
windows of WINDOW words, one every STRIDE words, so that they overlap; a document's score is that of its highest window,
through a logistic curve fitted to whole documents. Everything is trained here with numpy on a
bounded sample; evidence used in training comes from the other folds of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.llm import textbytes as tb
from salesgrid.llm.language import fold
from salesgrid.llm.mixing import BITS, id_hash

WINDOW, STRIDE = 32, 16
POSITIVE, NEGATIVE = 700, 1500  # labelled rows of each kind to learn from, about, by id hash
LONGEST = 200_000  # bytes of a text in the sample; scoring has no such limit
HIDDEN, EMBED = 8, 4
WORD_SLOTS, GRAM_SLOTS = 1 << 16, 1 << 17
GRAMS = (4, 6)
FOLDS, EPOCHS, BATCH, RATE = 4, 3, 64, 0.02
BLOCK = 512  # windows read at once

# letters in lower case, everything else in ASCII splits words
_PLAIN = np.full(256, 0x20, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_START = np.uint64(0x2545F4914F6CDD1D)  # tells a word's first n-grams from inner ones


class Words:
    """The words of a run of texts: slots of the distinct words and of their n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = _PLAIN[data]
        self.doc, start, end = tb.words(plain, offsets)
        self.first = tb.starts_of(self.doc, len(offsets) - 1)
        rolling = tb.Rolling(plain)
        hashes = rolling.of(start, end)
        value, at, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.slot = (value % np.uint64(WORD_SLOTS)).astype(np.int64)
        start, length = start[at], (end - start)[at]
        owner, slots = [], []
        for n in GRAMS:
            fits = np.flatnonzero(length >= n)
            many = length[fits] - n + 1
            who = np.repeat(fits, many)
            place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            h = rolling.of(start[who] + place, start[who] + place + n)
            h[place == 0] ^= _START
            owner.append(who)
            slots.append((tb.mix(h) % np.uint64(GRAM_SLOTS)).astype(np.int64))
        owner, slots = np.concatenate(owner), np.concatenate(slots)
        order = np.argsort(owner, kind="stable")
        self.gram, self.grams_from = slots[order], tb.starts_of(owner[order], len(value))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and length of every window; a text without words has none."""
        number = np.diff(self.first)
        many = np.where(number > 0, np.maximum(1, -(-(number - WINDOW) // STRIDE) + 1), 0)
        doc = np.repeat(np.arange(len(number)), many)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = self.first[doc] + place * STRIDE
        return doc, start, np.minimum(WINDOW, self.first[doc + 1] - start)


def evidence(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """How far the shares of documents are apart, in standard errors, cut and scaled."""
    p, q = (toxic + 0.1) / (n_toxic + 1), (other + 0.1) / (n_other + 1)
    both = (toxic + other + 0.5) / (n_toxic + n_other + 1)
    z = (p - q) / np.sqrt(both * (1 - both).clip(1e-3) * (1 / (n_toxic + 1) + 1 / (n_other + 1)))
    return (np.clip(z, -3, 15) / 5).astype(np.float32)


def _ranges(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the chosen rows of a ragged table, and the row each belongs to."""
    many = starts[which + 1] - starts[which]
    row = np.repeat(np.arange(len(which)), many)
    return np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + starts[which][row], row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights, the forward pass over windows and its gradient."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.w = {"word": small(WORD_SLOTS, EMBED) / 3, "gram": small(GRAM_SLOTS, EMBED) / 3}
        self.inputs = 2 * EMBED + 4
        for side in "fb":
            self.w["x" + side] = small(self.inputs, 3 * HIDDEN)
            self.w["h" + side] = small(HIDDEN, 3 * HIDDEN)
            self.w["c" + side] = np.zeros(3 * HIDDEN, np.float32)
        self.w |= {"a": small(2 * HIDDEN, HIDDEN), "v": small(HIDDEN), "o": small(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.word_evidence = np.zeros(WORD_SLOTS, np.float32)
        self.gram_evidence = np.zeros(GRAM_SLOTS, np.float32)
        self.slope, self.height = 1.0, 0.0

    def inputs_of(self, words: Words, which: np.ndarray, word_e: np.ndarray, gram_e: np.ndarray):
        """Input rows of the chosen distinct words, and the (entry, row) pairs of their n-grams."""
        entry, row = _ranges(words.grams_from, which)
        slot = words.gram[entry]
        many = np.maximum(1, np.bincount(row, minlength=len(which))).astype(np.float32)
        x = np.zeros((len(which), self.inputs), np.float32)
        x[:, :EMBED] = self.w["word"][words.slot[which]]
        for k in range(EMBED):
            x[:, EMBED + k] = np.bincount(row, self.w["gram"][slot, k], minlength=len(which)) / many
        e = gram_e[slot]
        x[:, -4] = word_e[words.slot[which]]
        x[:, -3] = np.bincount(row, e, minlength=len(which)) / many
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if len(starts):
            x[row[starts], -2] = np.maximum.reduceat(e, starts)
            x[row[starts], -1] = np.minimum.reduceat(e, starts)
        return x, slot, row, many

    def read(self, p: np.ndarray, u: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after every step, (steps, windows, HIDDEN); p holds the inputs' part, gate by gate."""
        h = np.zeros((p.shape[1], HIDDEN), np.float32)
        out = np.empty((p.shape[0], p.shape[1], HIDDEN), np.float32)
        full = mask.all(axis=1)
        for t in range(p.shape[0]):
            q = h @ u
            gates = _sigmoid(p[t, :, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(p[t, :, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if trace is not None:
                trace.append((h, r, z, n, q[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def pool(self, hf: np.ndarray, hb: np.ndarray, mask: np.ndarray):
        """Attention over the words of a window, and the window's logit."""
        h = np.concatenate([hf, hb], axis=2)
        t = np.tanh(h @ self.w["a"])
        s = np.where(mask, t @ self.w["v"], np.float32(-1e9))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        return h, t, a, pooled, pooled @ self.w["o"] + self.w["k"][0]

    def logits(self, words: Words, start: np.ndarray, length: np.ndarray, word_e=None, gram_e=None) -> np.ndarray:
        """The logit of every window."""
        word_e = self.word_evidence if word_e is None else word_e
        gram_e = self.gram_evidence if gram_e is None else gram_e
        x = self.inputs_of(words, np.arange(len(words.slot)), word_e, gram_e)[0]
        pf, pb = (x @ self.w["x" + s] + self.w["c" + s] for s in "fb")
        out = np.zeros(len(start), np.float32)
        for low in range(0, len(start), BLOCK):
            index, mask, back = self.steps(words, start[low : low + BLOCK], length[low : low + BLOCK])
            hf = self.read(pf[index], self.w["hf"], mask)
            turned = np.take_along_axis(index, back, axis=0)
            hb = self.read(pb[turned], self.w["hb"], mask)
            hb = np.take_along_axis(hb, back[:, :, None], axis=0)
            out[low : low + BLOCK] = self.pool(hf, hb, mask)[-1]
        return out

    @staticmethod
    def steps(words: Words, start: np.ndarray, length: np.ndarray):
        """Distinct word, presence, and place when read backwards, each (steps, windows)."""
        t = np.arange(int(length.max(initial=1)))[:, None]
        mask = t < length
        index = words.of[np.where(mask, start + t, start)]
        return index, mask, np.where(mask, length - 1 - t, t)

    def gradient(self, words: Words, start, length, label, word_e, gram_e) -> dict[str, np.ndarray]:
        index, mask, back = self.steps(words, start, length)
        which, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        x, slot, row, many = self.inputs_of(words, which, word_e, gram_e)
        turned = np.take_along_axis(local, back, axis=0)
        traces: dict[str, list] = {"f": [], "b": []}
        at = {"f": local, "b": turned}
        states = {s: self.read((x @ self.w["x" + s] + self.w["c" + s])[at[s]], self.w["h" + s], mask, traces[s]) for s in "fb"}
        hb = np.take_along_axis(states["b"], back[:, :, None], axis=0)
        h, t, a, pooled, logit = self.pool(states["f"], hb, mask)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "k": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.w["o"]
        d_h = a[:, :, None] * d_pooled
        d_a = (h * d_pooled).sum(axis=2)
        d_s = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_s, t)
        d_t = d_s[:, :, None] * self.w["v"] * (1 - t * t)
        g["a"] = np.einsum("tni,tnk->ik", h, d_t)
        d_h += d_t @ self.w["a"].T
        d_x = np.zeros_like(x)
        for s in "fb":
            d_out = d_h[:, :, :HIDDEN] if s == "f" else np.take_along_axis(d_h[:, :, HIDDEN:], back[:, :, None], axis=0)
            u = self.w["h" + s]
            d_u, d_p, carry = np.zeros_like(u), np.zeros((*local.shape, 3 * HIDDEN), np.float32), np.zeros_like(d_out[0])
            for k in range(len(d_out) - 1, -1, -1):
                before, r, z, n, qn = traces[s][k]
                d = d_out[k] + carry
                here = mask[k][:, None]
                dn = d * (1 - z) * (1 - n * n) * here
                dz = d * (before - n) * z * (1 - z) * here
                dr = dn * qn * r * (1 - r)
                dq = np.concatenate([dr, dz, dn * r], axis=1)
                d_p[k] = np.concatenate([dr, dz, dn], axis=1)
                d_u += before.T @ dq
                carry = np.where(here, d * z + dq @ u.T, d)
            flat = d_p.reshape(-1, 3 * HIDDEN)
            inputs = np.zeros((len(which), 3 * HIDDEN), np.float32)
            np.add.at(inputs, at[s].reshape(-1), flat)
            g["x" + s], g["h" + s], g["c" + s] = x.T @ inputs, d_u, flat.sum(axis=0)
            d_x += inputs @ self.w["x" + s].T
        g["word"] = (words.slot[which], d_x[:, :EMBED])
        g["gram"] = (slot, (d_x[:, EMBED : 2 * EMBED] / many[:, None])[row])
        return g


def _document_counts(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many of the chosen documents each word slot and each n-gram slot occurs."""
    pair = np.unique(np.stack([words.doc, words.of]), axis=1)
    pair = pair[:, chosen[pair[0]]]
    word = np.unique(pair[0] * WORD_SLOTS + words.slot[pair[1]]) % WORD_SLOTS
    entry, row = _ranges(words.grams_from, pair[1])
    gram = np.unique(pair[0][row] * GRAM_SLOTS + words.gram[entry]) % GRAM_SLOTS
    return np.bincount(word, minlength=WORD_SLOTS), np.bincount(gram, minlength=GRAM_SLOTS)


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network:
    """A network from labelled texts. Without both labels it scores every text alike."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.slope, net.height = 0.0, (4.0 if len(y) and y[0] else -4.0)
        return net
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    part = np.arange(len(y)) % FOLDS
    counts = [[_document_counts(words, (part == k) & (y == v)) for v in (1, 0)] for k in range(FOLDS)]

    def tables(out: int | None):
        use = [k for k in range(FOLDS) if k != out]
        sums = [[sum(counts[k][v][w] for k in use) for v in (0, 1)] for w in (0, 1)]
        n = [float(sum(((part == k) & (y == v)).sum() for k in use)) for v in (1, 0)]
        return [evidence(s[0], s[1], n[0], n[1]) for s in sums]

    by_fold = [tables(k) for k in range(FOLDS)]
    doc, start, length = words.windows()
    # to begin with a document stands for its window with the strongest words
    strength = np.zeros(len(doc), np.float32)
    for k in range(FOLDS):
        x = net.inputs_of(words, np.arange(len(words.slot)), *by_fold[k])[0]
        top = np.maximum(x[:, -4], x[:, -2])[words.of]
        sums = np.concatenate([[0], np.cumsum(np.maximum(top - 0.8, 0))])
        mine = part[doc] == k
        strength[mine] = (sums[start + length] - sums[start])[mine]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:  # the network itself now chooses the window that stands for a document
            for k in range(FOLDS):
                mine = np.flatnonzero(part[doc] == k)
                strength[mine] = net.logits(words, start[mine], length[mine], *by_fold[k])
        order = np.lexsort((-strength, doc))
        best = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        other = rng.permutation(np.flatnonzero(y[doc] == 0))[: len(best)]
        chosen = np.concatenate([best, best[y[doc[best]] == 1], other])
        for k in rng.permutation(FOLDS):
            mine = rng.permutation(chosen[part[doc[chosen]] == k])
            for low in range(0, len(mine), BATCH):
                pick = mine[low : low + BATCH]
                step += 1
                g = net.gradient(words, start[pick], length[pick], y[doc[pick]], *by_fold[k])
                for name, d in g.items():
                    w, (m, v) = net.w[name], moment[name]
                    at: object = slice(None)
                    if isinstance(d, tuple):  # rows of an embedding table
                        at, back = np.unique(d[0], return_inverse=True)
                        rows = np.zeros((len(at), EMBED), np.float32)
                        np.add.at(rows, back, d[1])
                        d = rows
                    m[at] = 0.9 * m[at] + 0.1 * d
                    v[at] = 0.99 * v[at] + 0.01 * d * d
                    w[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
    # a logistic curve over whole documents
    high = np.full(len(y), -8.0)
    for k in range(FOLDS):
        mine = np.flatnonzero(part[doc] == k)
        np.maximum.at(high, doc[mine], net.logits(words, start[mine], length[mine], *by_fold[k]))
    net.slope, net.height = _logistic(high, y)
    net.word_evidence, net.gram_evidence = tables(None)
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(a, 1e-3)), float(b)


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of every text: its highest window; texts without words get the lowest score."""
    high = np.full(len(offsets) - 1, -8.0)
    words = Words(data, offsets)
    if len(words.doc):
        doc, start, length = words.windows()
        np.maximum.at(high, doc, net.logits(words, start, length))
    return 1 / (1 + np.exp(-np.clip(net.slope * high + net.height, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic",
    id_col: str = "doc_id", text_col: str = "text",
) -> Network:
    """A network from about POSITIVE and NEGATIVE labelled rows where `learn` (over id_col) holds.

    Labels other than 0 and 1 are left out; an id labelled twice counts once, as toxic if one
    label says so. The sample is taken by a hash of the id.
    """
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("mark_id")).agg(F.max(label_col).alias("y"))
        .withColumn("h", id_hash("mark_id"))
    )
    known = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    below = {v: min(1 << BITS, int((1 << BITS) * most / max(1, known.get(v, 0)))) for v, most in ((1, POSITIVE), (0, NEGATIVE))}
    sample = marks.where(F.col("h") <= F.when(F.col("y") == 1, below[1]).otherwise(below[0]))
    # the sample has about POSITIVE + NEGATIVE ids, so it is sent to the documents, not they to it
    rows = (
        docs.where(learn & (F.octet_length(text_col) <= LONGEST))
        .select(F.col(id_col).alias("mark_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "mark_id").select("h", F.col("y").cast("int").alias("y"), "text").toPandas()
        .sort_values(["h", "text"])
    )
    return train(rows.text.tolist(), rows.y.tolist())


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of keep and score, over all windows of every whole text."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scores(net, data, offsets) for _, data, offsets in tb.chunks(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*names, "score"]
            )

    slim = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    types = dict(slim.dtypes)
    schema = ", ".join([*[f"{n} {types[n]}" for n in names], "score double"])
    return slim.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score"
    )


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; rows of fold 0 of 5 teach nothing."""
    net = fit(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, net).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
