"""The prefix trie, personal data and fill-in-middle, against brute force and round trips."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from salesgrid.llm import fim, pii, trie

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, c string, d string, k string, sum string, m string"
DOCS = "doc_id long, text string, id string, frames string, n string, row string, spans string, term string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = collections.defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = collections.defaultdict(int), collections.defaultdict(int)
    for path, group in members.items():
        gain = (len(group) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += gain
            leaves[path[:d]] += not kids[path]
    out = []
    for path, group in members.items():
        ends = ",".join(str(c) for c in sorted(group) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(group), len(path), parent, len(group), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(table, **more):
    return sorted(map(tuple, trie.prefix_trie(table, **more).collect()), key=str)


def conversations(spark):
    return spark.read.parquet(f"{FOLDER}/conversations.parquet")


def test_trie_equals_brute_force(spark):
    table = conversations(spark)
    assert trie_of(table) == brute_trie([tuple(r) for r in table.collect()])


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = []
    for c in (0, 1, 2, 3, 20, 21, 22, 40, 41, -1, -20, -25, 107):  # 107 has no base
        for t in range(c % 5):
            rows.append((c, t if c != 3 else None, "user" if t % 2 else None, f"turn {t} {'' if c % 2 else 'x'}"))
    rows += [(60, 0, "user", "a"), (60, 1, "us", "era"), (61, 0, "", None), (61, 1, None, ""), (62, 0, None, None)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    long = "wort " * 200_000
    rows += [(80, 0, "user", long), (81, 0, "user", long), (81, 1, "user", long + "end"), (82, 0, "use", "r" + long)]
    rows += [rows[0], rows[3], rows[3]]
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], TURNS)


def test_trie_of_odd_rows(spark, odd_turns):
    assert trie_of(odd_turns) == brute_trie([r[:4] for r in odd_turns.collect()])
    assert trie_of(odd_turns.where("false")) == []
    assert trie_of(odd_turns.where("conv_id IS NULL")) == []


def test_trie_starts_again_when_fingerprints_meet_by_chance(spark, odd_turns):
    assert trie_of(odd_turns, primes=(101, trie.PRIMES[0])) == brute_trie([r[:4] for r in odd_turns.collect()])


def test_trie_of_one_conversation_with_most_rows_and_a_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)  # three levels of blocks
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "user", f"w{t} w") for c in (40, 43) for t in range(900)]  # one long shared path
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 220) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert trie_of(table) == brute_trie(rows)


BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(zip(pii.KINDS, BASE, strict=True)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or luhn % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


HARD = [
    "a@b.c_d@e.f", "a@@b.c", "@b.c", "x@y", "x@y.z.", "1@2.3.4.5", "a.b+c%d@e-f.g-h", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 255.0.0.000255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "0000000000000000000", "00000000000000000000", "1 2 3 4 5 6 7 8 9 0 1 2",
    "+1 (017) 555-7713", "+1", "+12", "+1 ", "++1234567890", "+123456789+1234567890123456", "١٢٣٤٥٦٧٨٩٠١٢", "é@ü.de é.a@b.c",
    "4111111111111111.1.1.1", "1.1.1.4111111111111111", "mail a@b.co, +49 30 1234567; 10.0.0.1",
]


@pytest.mark.parametrize("text", HARD)
def test_base_spans_of_hard_texts(text):
    assert [(a, k, b) for a, k, b, _ in pii.entities(text)] == [s[:3] for s in brute_spans(text)]


def test_base_spans_of_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet="14 .-+@()aé_%", max_size=60))
    def check(text):
        assert [(a, k, b) for a, k, b, _ in pii.entities(text)] == [s[:3] for s in brute_spans(text)]

    check()


def test_base_spans_take_linear_time():
    for part in ("a", "1", "1.", "1 ", "a@", "+1 ", "@", "a.", "+1"):
        assert isinstance(pii.entities(part * (1_000_000 // len(part))), list)


def brute_revealing(texts, reach, support, disclosure):
    """The terms over the threshold and what stands for them, by plain counting."""
    alone, close, of = collections.Counter(), collections.Counter(), collections.Counter()
    for text in texts:
        text = text or ""
        found = [(a, b, f"{k}:{v}") for (a, _, b, k), (_, _, _, v) in zip(brute_spans(text), pii.entities(text), strict=True)]
        words = [m for m in re.finditer(r"[^\W_]+", "".join(
            " " if any(a <= i < b for a, b, _ in found) else c for i, c in enumerate(text)))]
        alone.update(m[0].lower() for m in words)
        for a, b, name in found:
            left, right = [m for m in words if m.start() < a], [m for m in words if m.start() > a]
            for m in left[-reach:] * (reach > 0) + right[:reach]:
                close[name, m[0].lower()] += 1
                of[name] += 1
    total = sum(alone.values())

    def over(both, n, name):
        return both >= support and math.log2(both * total / (n * of[name])) >= disclosure * math.log2(total / of[name]) - 1e-12

    strong = {t for (name, t), both in close.items() if len(t) >= pii.SHORTEST and over(both, alone[t], name)}
    out = {}
    for t in strong:
        same = [x for x in alone if len(x) >= pii.SHORTEST and x[: (len(x) + 1) // 2] == t[: (len(t) + 1) // 2]]
        tells = any(over(sum(close[name, x] for x in same), sum(alone[x] for x in same), name) for name in of)
        out[t] = None if tells else t[: (len(t) + 1) // 2] + "*"
    return out


def corpus():
    plain = [f"the word{i % 13} was common here and the smith{i % 3} too, smiles for all" for i in range(60)]
    secret = [f"the man here, Smithson{'' if i % 4 else ' Zyx'} wrote smithson.j@mail.example.org and the word{i} was common" for i in range(9)]
    cards = [f"Quux paid with 4111 1111 1111 1111 here, the word{i} was" for i in range(6)]
    return plain + secret + cards + ["", None, "no Smithson here", "quux"]


def test_revealing_terms_equal_plain_counting(spark):
    rows = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    got = {r["term"]: r["general"] for r in pii.revealing(rows, reach=3, support=4, disclosure=0.9).collect()}
    want = brute_revealing(corpus(), 3, 4, 0.9)
    assert got == want and "smithson" in got and "quux" in got and "the" not in got
    table = pii.find_spans(rows, pii.revealing(rows, reach=3, support=4, disclosure=0.9)).collect()
    for r, text in zip(sorted(table, key=lambda r: r["id"]), corpus(), strict=True):
        base = brute_spans(text or "")
        blank = "".join("\0" if any(a <= i < b for a, _, b, _ in base) else c for i, c in enumerate(text or ""))
        more = [(m.start(), 5 if want[m[0].lower()] is None else 4, m.end()) for m in re.finditer(r"[^\W_]+", blank) if m[0].lower() in want]
        assert [tuple(s)[:3] for s in r["spans"]] == sorted([s[:3] for s in base] + more)


def test_sanitised_texts_hold_no_revealing_term(spark):
    rows = spark.createDataFrame([(i, t, "e") for i, t in enumerate(corpus())], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(rows, reach=3, support=4, disclosure=0.9).collect()}
    assert not any("example.org" in t or "4111" in t or "Smithson" in t or "Quux" in t for t in out.values())
    assert out[0] == corpus()[0] and "[EMAIL]" in out[61] and "[CARD]" in out[70] and out[75] == ""


def test_pii_of_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    body = "word " * 300_000 + "a@b.co " + "x" * 3_000 + " 10.0.0.1"
    odd = [(-1, None), (-2, ""), (-3, body), (None, "call +49 30 1234567"), (-4, HARD[-1]), (-4, HARD[-1])]
    rows = [tuple(r) for r in docs.collect()] + odd
    table = spark.createDataFrame([(*r, "i", "f", "n", "r", "s", "t") for r in rows], DOCS)
    got = pii.scan_documents(table).collect()
    want = collections.Counter()
    for i, text in rows:
        spans = brute_spans(text or "")
        count = collections.Counter(s[3] for s in spans)
        want[(i, *(count[k] for k in pii.KINDS), hashlib.sha256(told(spans).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in pii.KINDS)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
    assert pii.scan_documents(table.where("false")).collect() == []


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(units), form, len(pre), len(mid), sha(out), sha(text)


def test_fim_equals_brute_force_on_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    texts = [None, "", " ", " \n x", "x \t", "<", "a < P> b <", "a <P> b", "é😀 z \x0b\x0c y" * 9, "w " * 200_000, "y" * 300_000, "\n" * 200_000 + "end", "<S"]
    odd = [(i, t) for t in texts for i in range(-12, 0)] + [(None, "a b c d"), (-5, "a b"), (-5, "a b")]
    rows = [tuple(r) for r in docs.collect()] + odd
    table = spark.createDataFrame([(*r, "i", "f", "n", "r", "s", "t") for r in rows], DOCS)
    got = fim.transform_documents(table)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_fim(*r) for r in rows)
    assert fim.transform_documents(table.where("false")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_fim_round_trip_over_frames_of_any_size(spark, size):
    texts = ["a <b c\n\n d", "  lead and trail  ", "<", "<P" "<S", "x<", "é 😀 ü " * 5, "", "one", "\t"]
    rows = [(100 * k + i, t) for k, t in enumerate(texts) for i in range(25)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    changed = fim.transform(fim.store(table, size=size), size=size)
    assert {r["id"]: r["text"] for r in fim.texts(changed, restored=True).collect()} == dict(rows)
    want = {r[0]: r[1:] for r in (brute_fim(*r) for r in rows)}
    for r in changed.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == want[r["id"]][:4]
    for r in fim.texts(changed).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["id"]][4]
    assert {r["form"] for r in changed.collect()} == {"plain", "psm", "spm"}
