"""The ten operators and the pipeline on small tables, against brute force."""

import collections
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from salesgrid.llm import (
    language, licenses, mixing, near_dedup, packing, quality, sharding, topk, toxicity, vector_dedup,
)

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, shard string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names."""
    body = " ".join(f"word{i % 97} other{i}" for i in range(20_000))
    texts = ["", " \n\t ", None, "one two", "One  TWO", body, body + " tail", "a b c d e f g", "a b c d e f g", "Ünï çødé 123"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [rows[7], rows[0], (None, "a b c d e f g", "en", "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_groups(rows):
    sets = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, odd):
    docs = documents(spark).limit(300)
    want = brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    want = brute_groups([tuple(r) for r in odd.where("doc_id is not null").select("doc_id", "text").collect()])
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_chain_of_near_copies_without_a_common_centre(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 12 : k * 12 + 200])) for k in range(12)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: v[1] for i, v in brute_groups(rows).items()}


def test_sharding(spark, odd):
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    for docs in (documents(spark), odd, hot, empty(spark)):
        rows = sharding.shard_documents(docs).collect()
        assert len(rows) == docs.count()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append((r["slot"], r["size"]))
        assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
        if docs is hot:
            sizes = [sum(b for _, b in v) for v in slots.values()]
            assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark).limit(120).select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id > 3 and doc_id <> 7")
        .withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(spark.createDataFrame(
            [(200_000, "a <|endoftext|> b<|endoftext|>")], "doc_id long, text string"))
    pieces = packing.pack(docs, with_ids=True).toPandas()
    for i, text in docs.collect():
        mine = pieces[pieces.doc_id == i].sort_values("start")
        ids = np.concatenate(mine.ids.to_list())
        assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (mine.doc_tokens == len(ids)).all() and (mine.start.to_numpy() == np.cumsum([0, *mine.length[:-1]])).all()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and (s.offset.to_numpy() == np.cumsum([0, *s.length[:-1]])).all()
    assert packing.pack(odd).agg(F.count("*")).first()[0] >= odd.count() and packing.pack(empty(spark)).count() == 0


def test_fullest_window_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(k): int(c) for k, c in zip(rng.integers(1, 60, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(20, 150))
        used = packing.fullest(counts, room)
        sums = {0}
        for k, c in counts.items():
            sums = {s + n * k for s in sums for n in range(c + 1)}
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/b/x.py", "no notice"), ("a/y.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"),
        ("z.py", None), ("ab/w.py", ""), (None, "Licensed under CC BY-NC 4.0."), ("a/b/x.py", "no notice"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r["path"]: (r["license"], r["inherited_from"]) for r in got}
    assert by == {
        "LICENSE": ("MIT", None), "a/COPYING": ("Apache-2.0", None), "a/b/x.py": ("Apache-2.0", "a"),
        "a/y.py": ("GPL-3.0", None), "z.py": ("MIT", ""), "ab/w.py": ("MIT", ""), None: ("CC-BY-NC-4.0", None),
    }
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_copyright_lines_and_prose_are_no_license(spark):
    rows = [(f"p{i}/f.txt", t) for i, t in enumerate([
        "Copyright (c) 2020 John Smith", "the copyright of this report is held by the authors",
        "Copyright 2019 The Foo Authors", "She renewed her fishing licence before the summer began.",
    ])] + [(f"q{i}/g.txt", f"the words of this text number {i} are by nobody") for i in range(400)]
    rows += [(f"r{i}/h.txt", "All rights reserved.") for i in range(3)]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).where("license is not null or is_license_file")
    assert sorted((r["path"], r["license"]) for r in got.collect()) == [(f"r{i}/h.txt", "Proprietary") for i in range(3)]


def test_license_texts_and_wrapped_headers(spark):
    texts = {k: v[0] for k, v in licenses.full_texts().items()}
    named = "Copyright (c) 2020 Jane Roe and the Quux developers\nAll rights reserved."
    rows = [(f"t{k}/LICENSE", re.sub(r"Copyright \(c\).*(\nAll rights reserved\.)?", named, v), k) for k, v in texts.items()]
    for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0"):
        wrapped = re.findall(r".{1,60}(?:\s|$)", licenses.HEADERS[k][0])
        rows.append((f"h{k}/a.py", "# quux.py\n# Copyright 2020 Jane Roe\n#\n" + "".join(f"# {x.strip()}\n" for x in wrapped) + "\nimport os\n" * 40, k))
        rows.append((f"j{k}/a.c", "/*\n" + "".join(f"{x.strip()}\n" for x in wrapped) + "*/\nint main() { return 0; }\n" * 40, k))
    rows.append(("r/README.md", "# Quux\n\nIt counts sheep at night.\n\n## License\n\n" + texts["MIT"] + "\n## Sheep\n\nThey are white.\n", "MIT"))
    rows += [(f"q{i}/g.txt", f"the words of this text number {i} are by nobody", None) for i in range(300)]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, want string").drop("want"))
    assert {r["path"]: r["license"] for r in got.collect()} == {p: want for p, _, want in rows}


def test_mixing(spark, odd):
    con = check.connect(FOLDER)
    assert check.compare(mixing.mix_documents(documents(spark)), con, mixing.ORACLE)[0] is None
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix_documents(empty(spark)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.12
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:5]]))]
    odd = [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [float("nan")] * 16), (404, []),
           (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (450, [1.0, 2.1]), (None, rows[3][1])]
    return spark.createDataFrame(rows + odd + [rows[10]], "vec_id long, embedding array<double>"), rows


def test_top_k_against_all(spark):
    table, _ = vectors(spark)
    got = sorted(tuple(r) for r in topk.search_embeddings(table).collect())
    whole = {}
    for r in table.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[r["vec_id"]] = [int(np.floor(256 * x)) for x in v]
    want = []
    for q, v in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole.items() if c != q and len(w) == len(v))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert got == sorted(want)


def test_top_k_of_huge_components_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** int(rng.integers(0, 12))]) for i in range(120)]
    rows += [(500, [1e300, -1e300, 1.0, 0.5]), (501, [1e300, -1e300, 2.0, 0.5]), (550, [-1e300, 1.0, 0.0, 1e-3])]
    exact = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for r in sorted(topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (i for i in exact if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], w, strict=True)), c) for c, w in exact.items() if c != q)[:5]
        assert got[q] == [(c, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, c in best]


def test_threshold_stops_before_the_end_of_the_lists():
    x = np.arange(4000)[:, None] * np.array([[1, 2]])
    rows, scores, depth = topk.Lists(np.arange(4000), x).top(np.array([3, 1]), -1, 5)
    assert list(rows) == [3999, 3998, 3997, 3996, 3995] and depth < 4000


def test_near_vectors_against_all_pairs(spark):
    table, _ = vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = {(a, b) for a in sound for b in sound if a != b and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.9}
    got = vector_dedup.near_vectors(table).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert 0.9 * len(links) <= found <= len(links)
    for r in got:
        if r["vec_id"] in (400, 401, 402, 403, 404, 405, None):
            assert r["n_links"] == 0 and r["kept"]


@pytest.mark.parametrize("operator,label,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_trained_scores(spark, odd, operator, label, least):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = operator.score_documents(documents(spark), labels)
    held = rows.where("held_out").join(labels, "doc_id").select("predicted", label, "score").toPandas()
    assert (held.predicted == held[label]).mean() >= least and held.score.between(0, 1).all()
    assert operator.score_documents(odd, labels).where("score between 0 and 1").count() == odd.count()
    none = labels.limit(0)
    assert operator.score_documents(odd, none).count() == odd.count() and operator.score_documents(empty(spark), labels).count() == 0


def test_languages(spark, odd):
    rows = language.identify_documents(documents(spark)).where("held_out").join(documents(spark).select("doc_id", "lang"), "doc_id")
    assert rows.where("lang = lang_pred").count() >= 0.98 * rows.count()
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_documents(odd).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"
    assert language.identify_documents(empty(spark)).count() == 0


def test_bloom_filters_return_all_languages_of_an_n_gram():
    rng = np.random.default_rng(0)
    held = {f"l{i:02}": rng.integers(0, 1 << 63, 500).astype(np.uint64) for i in range(70)}
    filters = language.Filters(held)
    for i, lang in enumerate(filters.langs):
        bits = filters.masks(held[lang], i // 64) >> np.uint64(i % 64) & np.uint64(1)
        assert bits.all() and filters.false[i] < 0.01


def test_network_gradient():
    net = toxicity.Network(1)
    data = b"aa bbbb cc dddddd aa ee ffff gg hhhhh"
    words = toxicity.Words(np.frombuffer(data, np.uint8), np.array([0, 20, len(data)]))
    doc, start, length = words.windows()
    label, e = np.array([1.0, 0.0], np.float32), (net.word_evidence, net.gram_evidence)
    g = net.gradient(words, start, length, label, *e)

    def loss():
        x = net.logits(words, start, length, *e).astype(float)
        return np.mean(np.log1p(np.exp(x)) - label * x)

    for name in ("xf", "hb", "a", "v", "o", "cf"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        was, step = net.w[name][at], 1e-2
        net.w[name][at] = was + step
        up = loss()
        net.w[name][at] = was - step
        down = loss()
        net.w[name][at] = was
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-2 * abs(g[name][at]) + 1e-4


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as cp

    a, b = "one two three four five six seven", "red green blue white black brown grey"
    c = "nine men went to mow the meadow"
    rows = [(5, a), (5, a), (5, a), (2, a), (None, a), (None, a), (None, b), (None, b), (8, b), (None, c), (None, c),
            (2, c), (11, "sun moon stars sky earth sea"), (11, "sun moon stars sky earth sea"), (3, ""), (3, ""), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cp.drop_near_duplicates(spark, docs, "").collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(
        [(2, a), (8, b), (2, c), (11, "sun moon stars sky earth sea"), (3, ""), (4, ""), (None, None)]
    )


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = cp.settle(stage(spark, docs, folder))
        if name == "MinHash near-dedup":
            kept = {i for i, (_, c) in brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()]).items() if i == c}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept
        if name != "packing":
            assert out.columns == columns and out.count() > 0
            docs = out
    assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
