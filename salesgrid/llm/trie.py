"""The prefix trie of rebuilt conversations, from composable fingerprints.

A turn has a hash t of its role and text, and k turns in a row have the fingerprint
t1 B + t2 B^2 + ... + tk B^k modulo a prime. Fingerprints form a group under concatenation:
(x, j) * (y, k) = (x + B^j y, j + k), so the prefix of a rebuilt conversation, a head of its base
followed by a part of its own turns, gets its fingerprint from those of the base's and its own
prefixes; rebuilt texts are never made. Equal prefixes meet by depth and fingerprint. Every prefix
keeps a reference to its last turn in the table of stored turns, and a group counts as equal only
if all its members refer to the same turn and turns of one reference have the same role and
text; if not, all is done again with another prime base.

A conversation is the smallest member of the nodes from some depth of its path to its end, its
chain. Sums over subtrees are sums over members of what their chains hold, less what the own
chain holds above the node. So every step is a join on a conversation, or a grouped sum over
prefixes, and their number grows with the number of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesgrid.llm.common import settle

HEAD, FAMILY = 4, 20  # head lengths 0 to 3; conversations of a base
PRIMES = ((1 << 127) - 1,)
TRIES = 8
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096  # rows of a block of a running total
IDS = 1 << 15  # ids of a chunk that is hashed as one row


def _base(salt: int, prime: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {salt}".encode()).digest(), "big") % (prime - 3) + 2


def _packed(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_NUMBERED = "c long, k long, sum binary, turn_ref binary, w long"


def _numbered(hashed: DataFrame, salt: int, prime: int) -> DataFrame:
    """c, k (place of the turn, from 1), sum (fingerprint of the first k turns), turn_ref and w.

    Rows are dealt by ranges of (c, turn), so one conversation may lie in many partitions: each
    is numbered by itself, and what a partition's first conversation has before it, one row for
    a partition, is put in front of it.
    """
    base = _base(salt, prime)
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("turn_ref"), F.col("_salt")]
    parts = max(1, int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = pa.schema([("part", pa.int32()), ("c", pa.int64()), ("k", pa.int64()), ("sum", pa.binary()), ("turn_ref", pa.binary()), ("w", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def scan() -> Iterator[tuple]:
            now, k, total, power = None, 0, 0, 1
            for c, ref, w in _rows(batches):
                if c != now:
                    now, k, total, power = c, 0, 0, 1
                k, power = k + 1, power * base % prime
                total = (total + _number(ref) * power) % prime
                yield part, c, k, _packed(total), ref, w

        yield from _batches(scan(), kinds)

    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "turn_ref", "w")
    scanned = settle(ranged.mapInArrow(local, f"part int, {_NUMBERED}"))
    # a conversation in several partitions is the first or the last of each: two rows a partition
    ends = scanned.groupBy("part", "c").agg(F.max(F.struct("k", "sum")).alias("e"))
    over = ends.groupBy("c").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("part", "e.k", "e.sum"))).alias("ends"))
    carry: dict[tuple[int, int], tuple[int, int]] = {}
    for row in over.where("n > 1").toLocalIterator():
        k, total = 0, 0
        for part, more, added in row["ends"]:
            carry[part, row["c"]] = k, total
            total = (total + _number(added) * pow(base, k, prime)) % prime
            k += more

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> Iterator[tuple]:
            for part, c, k, total, ref, w in _rows(batches):
                before, head = carry.get((part, c), (0, 0))
                if before:
                    total = _packed((head + _number(total) * pow(base, before, prime)) % prime)
                yield c, k + before, total, ref, w

        yield from _batches(put(), pa.schema(list(kinds)[1:]))

    return settle(scanned.mapInArrow(joined, _NUMBERED))


_PREFIX = "c long, d long, sum binary, turn_ref binary, w long, last boolean"


def _prefixes(numbered: DataFrame, head: Column, salt: int, prime: int) -> DataFrame:
    """c, d, sum, turn_ref, w and last (the rebuilt conversation ends there) of all prefixes, d from 0."""
    base = _base(salt, prime)
    firsts = [
        F.max(F.when(F.col("k") == k, F.struct("sum", "turn_ref", "w"))).alias(f"f{k}") for k in range(1, HEAD)
    ]
    heads = settle(numbered.groupBy("c").agg(F.max("k").alias("n"), *firsts))
    first = F.array(*[f"f{k}" for k in range(1, HEAD)])
    own = heads.select("c", "n", head.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("b"), first.alias("own"))
    bases = heads.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("b"), F.col("n").alias("bn"), first.alias("given"))
    plan = settle(
        own.join(bases, "b", "left")
        .withColumn("g", F.least("h", F.coalesce("bn", F.lit(0))))  # turns that the base gives
        .select(
            "c", "h", "g", "n", F.slice("given", 1, F.col("g")).alias("given"),
            F.get("own", (F.col("h") - 1).cast("int"))["sum"].alias("skip"),
        )
    )
    length = F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    root = plan.select(
        "c", F.lit(0).cast("long").alias("d"), F.lit(bytearray(16)).alias("sum"), F.lit(None).cast("binary").alias("turn_ref"),
        F.lit(0).cast("long").alias("w"), (length == 0).alias("last"),
    )
    given = plan.select("c", length.alias("length"), F.posexplode("given").alias("at", "f")).select(
        "c", (F.col("at") + 1).cast("long").alias("d"), "f.sum", "f.turn_ref", "f.w", (F.col("length") == F.col("at") + 1).alias("last"),
    )
    rest = numbered.join(
        plan.select("c", "h", "g", "n", "skip", F.get("given", (F.col("g") - 1).cast("int"))["sum"].alias("front")), "c"
    ).where("k > h").select("c", "k", "sum", "turn_ref", "w", "h", "g", "n", "skip", "front")
    kinds = pa.schema([("c", pa.int64()), ("d", pa.int64()), ("sum", pa.binary()), ("turn_ref", pa.binary()), ("w", pa.int64()), ("last", pa.bool_())])
    moved = {j: pow(base, j, prime) for j in range(1 - HEAD, HEAD)}

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> Iterator[tuple]:
            for c, k, total, ref, w, h, g, n, skip, front in _rows(batches):
                tail = (_number(total) - (_number(skip) if skip else 0)) * moved[g - h]
                whole = ((_number(front) if front else 0) + tail) % prime
                yield c, g + k - h, _packed(whole), ref, w, k == n

        yield from _batches(put(), kinds)

    return root.unionByName(given).unionByName(rest.mapInArrow(compose, _PREFIX))


def _sound(nodes: DataFrame, turns: DataFrame, hashed: DataFrame) -> bool:
    """Whether each group's members refer to one turn, and rows of one reference hold the same role and text."""
    if nodes.where("first_ref <> last_ref").limit(1).count():
        return False
    repeated = settle(hashed.groupBy("turn_ref").agg(F.count("*").alias("n")).where("n > 1").select("turn_ref"))
    # both settled, so that a reference with most of the rows can be split in the join and is aggregated before it meets
    again = settle(turns.join(repeated, "turn_ref", "left_semi").select("turn_ref", "role", "text"))
    told = again.groupBy("turn_ref").agg(*[x(c).alias(f"{x.__name__}_{c}") for c in ("role", "text") for x in (F.min, F.max)])
    return not told.where("min_role <> max_role OR min_text <> max_text").limit(1).count()


def running(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over smaller `at` of the same keys; `at` counts whole numbers from 0.

    Blocks of BLOCK places are summed by themselves and the totals of blocks in the same way, so
    no window holds more than BLOCK rows.
    """
    whole, block = F.floor(F.col(at) / BLOCK).cast("long"), f"_{at}b"
    most = rows.agg(F.max(at)).first()[0] or 0
    inside = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(block, whole).withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if most < BLOCK:
        return out.drop(block)
    totals = rows.groupBy(*keys, whole.alias(block)).agg(F.sum(value).alias(f"_{value}"))
    above = running(totals, keys, block, f"_{value}", f"_{name}").drop(f"_{value}")
    return out.join(above, [*keys, block]).withColumn(name, F.col(name) + F.col(f"_{name}")).drop(block, f"_{name}")


def id_digests(ids: DataFrame, group: list[str], id_col: str, name: str) -> DataFrame:
    """Per group: SHA-256 of its ids as decimals, ascending, joined by commas.

    Ids are dealt by ranges of group and id and folded into compressed chunks of up to IDS ids where
    they lie; a group's chunks, not its ids, meet in one task, which hashes them as they come.
    """
    kinds = ", ".join(f"{g} long" for g in group)
    width = len(group)
    chunk = pa.schema([*[(g, pa.int64()) for g in group], ("low", pa.int64()), ("ids", pa.binary())])
    done = pa.schema([*[(g, pa.int64()) for g in group], (name, pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress

        def chunks() -> Iterator[tuple]:
            now, held = None, []
            for *key, i in _rows(batches):
                if held and (key != now or len(held) == IDS):
                    yield (*now, held[0], pack(",".join(map(str, held)).encode()))
                    held = []
                now = key
                held.append(i)
            if held:
                yield (*now, held[0], pack(",".join(map(str, held)).encode()))

        yield from _batches(chunks(), chunk, 64)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def hashes() -> Iterator[tuple]:
            now, total = None, None
            for row in _rows(batches):
                key = row[:width]
                if key != now:
                    if now is not None:
                        yield (*now, total.hexdigest())
                    now, total = key, hashlib.sha256()
                else:
                    total.update(b",")
                total.update(unpack(row[-1]))
            if now is not None:
                yield (*now, total.hexdigest())

        yield from _batches(hashes(), done)

    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = ids.select(*[F.col(g).cast("long") for g in group], F.col(id_col).cast("long").alias("_i"))
    order = [*group, "_i"]
    folded = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(fold, f"{kinds}, low long, ids binary")
    return folded.repartition(*group).sortWithinPartitions(*group, "low").mapInArrow(finish, f"{kinds}, {name} string")


def prefix_trie(conversations: DataFrame, head: Column | None = None, primes: Sequence[int] = PRIMES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as the contract of the query
    says. `head` is the number of the base's turns that conversation c takes, below HEAD, by
    default crc32(c as text) modulo HEAD.

    Turns are ordered by turn, nulls first; turns of one number by the digest of role and text.
    A repeated row is a turn more. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and take no part. An empty table has no nodes. Only conv_id, turn,
    role and text are read, so other columns may have any names. One conversation, prefix or
    group of copies may hold any share of the rows.
    """
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEAD if head is None else head
    stored = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    for salt in range(TRIES):
        prime = primes[min(salt, len(primes) - 1)]
        content = F.concat(F.lit(f"{salt}:"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
        turns = stored.withColumn("turn_ref", F.unhex(F.substring(F.sha2(content, 256), 1, 32)))
        hashed = settle(turns.select(
            "c", "turn", "turn_ref", F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"),
            F.monotonically_increasing_id().alias("_salt"),
        ))
        prefixes = settle(_prefixes(_numbered(hashed, salt, prime), head, salt, prime))
        nodes = settle(prefixes.groupBy("d", "sum").agg(
            F.count("*").alias("n_convs"), F.min("c").alias("m"), F.count_if("last").alias("n_ends"),
            F.min("turn_ref").alias("first_ref"), F.max("turn_ref").alias("last_ref"),
        ))
        if _sound(nodes, turns, hashed):
            return _trie(prefixes, nodes)
    raise ValueError(f"fingerprints met by chance {TRIES} times")


def _trie(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    # every prefix with its node; the root, which all members share, needs no join
    kept = ["m", "n_convs", "n_ends"]
    root = nodes.where("d = 0").select(kept).first() or dict.fromkeys(kept)
    deep = prefixes.where("d > 0").join(nodes.where("d > 0").select("d", "sum", *kept), ["d", "sum"])
    top = prefixes.where("d = 0").select("*", *[F.lit(root[k]).cast("long").alias(k) for k in kept])
    columns = ["c", "d", "m", "n_convs", "n_ends", "w", "last"]
    placed = settle(deep.select(columns).unionByName(top.select(columns)))
    mine = F.col("m") == F.col("c")
    saving = (F.col("n_convs") - 1) * F.col("w")
    chains = settle(placed.groupBy("c").agg(
        F.min(F.when(mine, F.col("d"))).alias("top"), F.max_by(F.when(~mine, F.col("m")), F.when(~mine, F.col("d"))).alias("parent"),
        F.coalesce(F.sum(F.when(mine, saving)), F.lit(0)).alias("chain_saved"),
        # the chain's last node has no child if all its members end there
        F.count_if(mine & F.col("last") & (F.col("n_ends") == F.col("n_convs"))).alias("leaf"),
    ))
    whole = (
        placed.select("c", "d", "m").join(chains.select("c", "chain_saved", "leaf"), "c")
        .groupBy("m", "d").agg(F.sum("chain_saved").alias("members_saved"), F.sum("leaf").alias("n_leaves"))
    )
    branches = chains.where("top > 0").groupBy(F.col("parent").alias("m"), (F.col("top") - 1).alias("d")).agg(F.count("*").alias("branches"))
    heads = chains.select(F.col("c").alias("m"), "top", "parent")
    own = placed.where(mine).select("m", "d", "n_convs", "n_ends", "last", saving.alias("saving")).join(heads, "m")
    # settled, or the running total would inherit a dealing by conversation alone
    above = running(settle(own.withColumn("place", F.col("d") - F.col("top"))), ["m"], "place", "saving", "above")
    # a chain's nodes are its conversation's prefixes from `top` on, so only its last has no next node
    ends = id_digests(placed.where("last"), ["m", "d"], "c", "ends_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        above.join(whole, ["m", "d"]).join(branches, ["m", "d"], "left").join(ends, ["m", "d"], "left")
        .select(
            F.col("m").alias("conv_id"), F.col("d").alias("depth"),
            F.when(F.col("d") > F.col("top"), F.col("m")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
            (F.coalesce("branches", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1)).cast("long").alias("n_children"),
            "n_leaves", (F.col("members_saved") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


ORACLE = r"""
WITH crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
h AS (
  SELECT conv_id AS c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1),
           lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 4 AS h
  FROM crc),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT h.c, b.k AS o, b.role, b.text FROM h JOIN t b ON b.c = h.c - h.c % 20 AND b.k <= h.h
  UNION ALL
  SELECT h.c, 4 + t.k, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.k > h.h),
p AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, {'role': role, 'text': text} AS turn,
         array_agg({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY o) AS path
  FROM r),
q AS (SELECT c, d, path FROM p UNION ALL SELECT c, 0, [] FROM h),
l AS (SELECT c, max(d) AS len FROM q GROUP BY c),
n AS (
  SELECT q.d, q.path, min(q.c) AS m, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN l.len = q.d THEN CAST(q.c AS VARCHAR) END, ',' ORDER BY q.c), '') AS ends
  FROM q JOIN l USING (c) GROUP BY q.d, q.path),
w AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) END AS s FROM n),
k AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT w.*, coalesce(k.kids, 0) AS kids FROM w LEFT JOIN k ON w.d = k.d AND w.path = k.path),
a AS (SELECT x.*, unnest(range(0, x.d + 1)) AS up FROM x),
sub AS (
  SELECT up AS d, path[1:up] AS path, sum(s) AS saved, count_if(kids = 0) AS leaves FROM a GROUP BY ALL)
SELECT x.m AS conv_id, x.d AS depth, y.m AS parent_conv_id, x.n_convs, x.kids AS n_children,
       CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN sub ON x.d = sub.d AND x.path = sub.path LEFT JOIN n y ON y.d = x.d - 1 AND y.path = x.path[1:x.d - 1] AND x.d > 0"""
