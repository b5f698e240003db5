"""Trie of conversation prefixes by radix partitioning on turn ids.

Turns are encoded by a dictionary of their digests, so a conversation is a sequence of numbers. Buckets hold conversations with
a common prefix, the root holds all. A bucket of over ``LIMIT`` rows is split by Spark: a grouped minimum and maximum
of the ids at each depth tell how far its members go on together, those nodes are emitted as one chain, and the next id deals the members
into new buckets. Copies of a conversation, however many or long, so end in one chain. Every other bucket goes
to one task, where a multikey quicksort deals the rest and emits its nodes; a task holds one such bucket at a time.
Sums over subtrees then climb from the deepest buckets to the root.

No key gathers rows: shares of a hot bucket are counted before they are shuffled, joins are left to Spark's splitting of skewed
partitions, conversations are numbered over sorted ranges that may cut through one, and the ids that end at a node are joined in ranges first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_SEPARATORS, discard, staged

#: Rows of a bucket that one task finishes.
LIMIT = 128
#: Conversations in a block of ids, of which the first one lends its head to the others; heads are of up to 3 turns.
BLOCK, HEADS = 20, 4
#: Ids joined to one string before they are hashed; depths of a chain that are summed together.
IDS, DEPTHS = 8192, 4096
ROW = ("m", "e", "c", "d", "tid", "w")
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SPLIT = str.maketrans(dict.fromkeys(WORD_SEPARATORS, " "))


def emitted(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(list(c), kind) for c, (_, kind) in zip(columns, kinds)], names=[n for n, _ in kinds])


def batched(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield emitted(held, kinds)
            held = []
    yield emitted(held, kinds)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)


def encoded_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, pos, tid, w``: turns numbered from 1, the id of role and text, and the words of the text; staged.

    Rows are sorted by ranges of (conversation, turn, role, text) and numbered in each range; what earlier ranges hold of a
    conversation is added, of which two at most cross the borders of a range.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0

        def numbered() -> Iterator[tuple]:
            nonlocal last, k
            for conv, role, said in rows_of(batches):
                last, k = conv, k + 1 if conv == last else 1
                head = role.encode()
                digest = hashlib.sha256(len(head).to_bytes(8, "big") + head + said.encode()).digest()
                yield conv, part, k, digest, sum(map(bool, said.translate(_SPLIT).split(" ")))

        yield from batched(numbered(), [("conv", pa.int64()), ("part", pa.int64()), ("k", pa.int64()), ("digest", pa.binary()), ("w", pa.int64())])

    order = ["conv", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    turns = staged(ranged.mapInArrow(number, "conv long, part long, k long, digest binary, w long"), "turns")
    codes = staged(turns.select("digest").distinct().withColumn("tid", F.monotonically_increasing_id()), "codes")
    counts = turns.groupBy("conv", "part").agg(F.max("k").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.join(counts.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1"), "conv", "left_semi").select("conv", "part", before.alias("before"))
    numbered = turns.join(codes, "digest").join(offsets, ["conv", "part"], "left")
    out = staged(numbered.select("conv", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "w"), "encoded")
    discard(turns, codes)
    return out


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Sequences ``c, d, tid, w, len`` and all conversations ``c, len``, the turnless ones too; staged.

    The first h turns come from the block's first conversation, the rest are the own ones after the first h.
    """
    own = turns.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).alias("h"), (F.col("conv") - F.col("conv") % block).alias("donor"))
    given = own.select(F.col("conv").alias("donor"), F.col("n").alias("n_donor"))
    lent = F.least("h", F.coalesce("n_donor", F.lit(0)))
    size = F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h")) + lent
    convs = staged(own.join(given, "donor", "left").select("conv", "donor", "h", lent.alias("lent"), size.alias("len")), "conversations")
    first = turns.where(F.col("pos") < heads).select(F.col("conv").alias("donor"), "pos", "tid", "w")
    head = convs.join(first, "donor").where("pos <= h").select(F.col("conv").alias("c"), F.col("pos").alias("d"), "tid", "w", "len")
    tail = turns.join(convs, "conv").where("pos > h").select(F.col("conv").alias("c"), (F.col("pos") - F.col("h") + F.col("lent")).alias("d"), "tid", "w", "len")
    return staged(head.union(tail), "sequences"), convs.select(F.col("conv").alias("c"), "len")


def finished(m: int, e: int, members: list[tuple[int, list[int], list[int]]]) -> tuple[list[list], tuple[int, int, int]]:
    """Nodes below the node ``(m, e)`` whose members go on as given: (conversation, ids, words).

    Multikey quicksort: members are parted in three by the id at the present depth; those equal to the pivot are a node and go
    on one deeper, the rest is parted again. Also the number of children of ``(m, e)``, the childless nodes and the saved tokens below it.
    """
    nodes: list[list] = []
    stack = [(members, 0, -1)]
    while stack:
        part, k, up = stack.pop()
        pivot = part[len(part) // 2][1][k]
        less, same, more = [], [], []
        for x in part:
            (same if (t := x[1][k]) == pivot else less if t < pivot else more).append(x)
        stack += [(x, k, up) for x in (less, more) if x]
        conv, rest = min(x[0] for x in same), [x for x in same if len(x[1]) > k + 1]
        ends = ",".join(map(str, sorted(x[0] for x in same if len(x[1]) == k + 1)))
        nodes.append([conv, e + k + 1, nodes[up][0] if up >= 0 else m, len(same), 0, 0, (len(same) - 1) * same[0][2][k], hashlib.sha256(ends.encode()).hexdigest() if ends else NO_ENDS, up])
        if rest:
            stack.append((rest, k + 1, len(nodes) - 1))
    below = [0, 0, 0]
    for node in reversed(nodes):  # parents come before their children
        node[5] = node[5] or 1
        above = nodes[node[8]] if node[8] >= 0 else None
        if above:
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
        else:
            below = [below[0] + 1, below[1] + node[5], below[2] + node[6]]
    return nodes, tuple(below)


def local_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the buckets in ``rows(m, e, c, d, tid, w)`` and, with a null depth, what lies below each bucket's node."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (m, e), bucket in groupby(rows_of(batches), key=lambda r: (r[0], r[1])):
                members = []
                for c, turns in groupby(bucket, key=lambda r: r[2]):
                    at = list(turns)
                    members.append((c, [r[4] for r in at], [r[5] for r in at]))
                nodes, (children, leaves, saved) = finished(m, e, members)
                yield from (tuple(n[:8]) for n in nodes)
                yield m, None, e, 0, children, leaves, saved, None

        names = [x.split(" ")[0] for x in NODE.split(", ")]
        yield from batched(found(), [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in names])

    key = ["m", "e", "c", "d"]
    return rows.repartition("m", "e").sortWithinPartitions(*key).mapInArrow(finish, NODE)


def sums_from(rows: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys from ``at`` on; long runs are summed block by block."""
    rows = rows.withColumn("blk", F.floor(F.col(at) / DEPTHS))
    blocks = rows.groupBy(*keys, "blk").agg(F.sum(value).alias("of"))
    after = Window.partitionBy(*keys).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "blk", F.coalesce(F.sum("of").over(after), F.lit(0)).alias("after"))
    within = Window.partitionBy(*keys, "blk").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, [*keys, "blk"]).withColumn(name, F.col("after") + F.sum(value).over(within)).drop("blk", "after")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One level over buckets ``m, e, c, d, tid, w, len``: the chain of each, its new nodes, the rows below those, and both kinds of ends.

    Chain: ``m, e, conv, depth, parent, n, w``. Nodes: ``m, e, km, kd, parent, n, w, left`` with the rows left below each.
    Rows: as given, in their new buckets, with ``left``. Ends: ``conv, depth, c``.
    """
    at = staged(rows.groupBy("m", "e", "d").agg(F.count("*").alias("n"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min("c").alias("conv"), F.max("w").alias("w")), "depths")
    going = at.groupBy("m", "e").agg(F.max("n").alias("all"), F.max("d").alias("last"), F.min("conv").alias("conv"))  # all that go on have the first of these turns
    parts = F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("n") < F.col("all")), F.col("d")))
    ends_at = at.drop("conv").join(going, ["m", "e"]).groupBy("m", "e", "last", "conv").agg(parts.alias("parts"))
    to = staged(ends_at.select("m", "e", "conv", F.coalesce(F.col("parts") - 1, "last").alias("to")), "chains")
    parent = F.when(F.col("depth") == F.col("e") + 1, F.col("m")).otherwise(F.col("conv"))
    line = at.drop("conv").join(to, ["m", "e"]).where("d <= to").withColumnRenamed("d", "depth").select("m", "e", "conv", "depth", parent.alias("parent"), "n", "w")
    chain_ends = rows.where("d = len").join(to, ["m", "e"]).where("d = to").select("conv", F.col("d").alias("depth"), "c")

    rest = rows.join(to, ["m", "e"]).where("d > to")
    digits = rest.where("d = to + 1")
    above = F.when(F.col("to") > F.col("e"), F.col("conv")).otherwise(F.col("m"))
    nodes = digits.groupBy("m", "e", "tid", above.alias("parent"), F.col("d").alias("kd")).agg(F.count("*").alias("n"), F.min("c").alias("km"), F.max("w").alias("w"), F.sum(F.col("len") - F.col("d")).alias("left"))
    nodes = staged(nodes, "nodes")
    placed = staged(digits.select("m", "e", "tid", "c", "d", "len").join(nodes.select("m", "e", "tid", "km", "kd", "left"), ["m", "e", "tid"]).select("c", "km", "kd", "left", (F.col("d") == F.col("len")).alias("over")), "placed")
    below = rest.where("d > to + 1").select("c", "d", "tid", "w", "len").join(placed.where("not over").select("c", F.col("km").alias("m"), F.col("kd").alias("e"), "left"), "c")
    return line, nodes, staged(below, "buckets"), chain_ends, placed.where("over").select(F.col("km").alias("conv"), F.col("kd").alias("depth"), "c")


def end_hashes(ends: DataFrame) -> DataFrame:
    """``conv, depth, ends``: SHA-256 of the ids that end at each node, ascending; the ids of a node may lie in many ranges."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strings() -> Iterator[tuple]:
            for (conv, depth), rows in groupby(rows_of(batches), key=lambda r: r[:2]):
                ids = (r[2] for r in rows)
                for first in ids:
                    run = [first]
                    for c in ids:
                        run.append(c)
                        if len(run) == IDS:
                            break
                    yield conv, depth, first, ",".join(map(str, run))

        yield from batched(strings(), [("conv", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())], 100)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for (conv, depth), rows in groupby(rows_of(batches), key=lambda r: r[:2]):
                state = hashlib.sha256()
                for k, (_, _, _, ids) in enumerate(rows):
                    state.update(b"," * bool(k) + ids.encode())
                yield conv, depth, state.hexdigest()

        yield from batched(digests(), [("conv", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])

    order = ["conv", "depth", "c"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "conv long, depth long, first long, ids string")
    return runs.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(hashed, "conv long, depth long, ends string")


def prefix_trie(sequences: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``sequences(c, d, tid, w, len)``, d from 1 to len, for conversations ``convs(c, len)``. No rows for no conversations."""
    spark = sequences.sparkSession
    root = convs.agg(F.min("c").alias("m"), F.count("*").alias("n"), F.sum("len").alias("left")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODE)
    open_rows = sequences.select(F.lit(root["m"]).alias("m"), F.lit(0).cast("long").alias("e"), "c", "d", "tid", "w", "len", F.lit(root["left"]).alias("left"))
    left, levels, local = root["left"], [], []
    ends = [convs.where("len = 0").select(F.lit(root["m"]).alias("conv"), F.lit(0).cast("long").alias("depth"), "c")]
    while left > limit:
        line, nodes, below, *more = split(open_rows.where(F.col("left") > limit))
        levels.append((line, nodes))
        ends += more
        local.append(open_rows.where(F.col("left") <= limit).select(*ROW))
        open_rows, left = below, nodes.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    local.append(open_rows.select(*ROW))
    done = staged(local_nodes(reduce(DataFrame.union, local)), "local")

    # what lies below a node: its children, their childless nodes and saved tokens
    sums = [F.sum(x).alias(x) for x in ("children", "leaves", "saved")]
    below = done.where("depth is null").select(F.col("conv_id").alias("m"), F.col("parent_conv_id").alias("e"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    upper = []
    saves, some = (F.col("n") - 1) * F.col("w"), lambda c, x: F.coalesce(c, F.lit(x)).cast("long")
    for line, nodes in reversed(levels):
        full = nodes.join(below.withColumnsRenamed({"m": "km", "e": "kd"}), ["km", "kd"], "left")
        full = staged(full.select("m", "e", "km", "kd", "parent", "n", some("children", 0).alias("children"), some("leaves", 1).alias("leaves"), (some("saved", 0) + saves).alias("saved")), "counted")
        upper.append(full.select("km", "kd", "parent", "n", "children", "leaves", "saved"))
        of = full.groupBy("m", "e").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        run = sums_from(line.withColumn("own", saves), ["m", "e"], "depth", "own", "run")
        ends_at = line.groupBy("m", "e").agg(F.max("depth").alias("last"))
        run = run.join(ends_at, ["m", "e"]).join(of, ["m", "e"], "left")
        children = F.when(F.col("depth") < F.col("last"), F.lit(1)).otherwise(some("children", 0)).cast("long")
        run = staged(run.select("m", "e", "conv", "depth", "parent", "n", children.alias("children"), some("leaves", 1).alias("leaves"), (F.col("run") + some("saved", 0)).alias("saved")), "lines")
        upper.append(run.select("conv", "depth", "parent", "n", "children", "leaves", "saved"))
        top = run.where("depth = e + 1").select("m", "e", F.lit(1).cast("long").alias("children"), "leaves", "saved")
        short = of.join(top, ["m", "e"], "left_anti").select("m", "e", "children", "leaves", "saved")
        below = staged(below.union(top).union(short), "below")
    start = spark.range(1).select(F.lit(root["m"]).alias("m"), F.lit(0).cast("long").alias("e")).join(below, ["m", "e"], "left")
    upper.append(start.select("m", "e", F.lit(None).cast("long"), F.lit(root["n"]), some("children", 0), some("leaves", 1), some("saved", 0)))
    nodes = reduce(DataFrame.union, upper).toDF("conv", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    nodes = nodes.join(end_hashes(reduce(DataFrame.union, ends)), ["conv", "depth"], "left")
    nodes = nodes.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    return nodes.union(done.where("depth is not null"))


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """The trie of the conversations rebuilt with shared heads: a row for each distinct sequence of first turns.

    The first h turns, h the unsigned CRC-32 of the decimal id modulo 4, come from conversation ``id - id % 20`` (SQL's ``%``, so -7 is
    in the block of 0), the rest are the own ones after the first h. Turns are ordered by ``turn``, null first, then by role and text; a null role or text is empty. Rows without a
    conversation id belong to none and are left out; repeated rows are turns of their own. Other columns are left out whatever
    their names. An empty table gives no rows, not even a root.
    """
    turns = encoded_turns(conversations, conv_col, turn_col, role_col, text_col)
    sequences, convs = rebuilt(turns)
    discard(turns)
    return prefix_trie(sequences, convs, limit)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = {
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT c, c - c % 20 AS donor, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT c.c, t.pos AS o, t.role, t.text FROM c JOIN t ON t.conv_id = c.donor AND t.pos <= c.h
  UNION ALL SELECT c.c, t.pos + 1000 AS o, t.role, t.text FROM c JOIN t ON t.conv_id = c.c AND t.pos > c.h),
s AS (SELECT c, list({'r': role, 't': text} ORDER BY o) AS seq FROM r GROUP BY c),
m AS (SELECT c.c, coalesce(s.seq, []) AS seq FROM c LEFT JOIN s USING (c)),
p AS (SELECT c, d, seq[1:d] AS pre, len(seq) AS n FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM m)),
node AS (
  SELECT min(c) AS conv_id, d AS depth, pre, count(*) AS n_convs, max(n) = d AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY d, pre),
priced AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[depth].t, '[^ 	-
]+')) END AS saves FROM node),
sub AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (b.depth = a.depth + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves, sum(b.saves) AS saved_tokens
  FROM priced a JOIN priced b ON b.depth >= a.depth AND b.pre[1:a.depth] = a.pre GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM priced n JOIN sub s USING (conv_id, depth) LEFT JOIN priced up ON up.depth = n.depth - 1 AND up.pre = n.pre[1:n.depth - 1]
"""
}
