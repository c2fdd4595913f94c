"""Trie of conversation prefixes: who shares which first turns, and what that saves.

Turns become fixed-width ids (16 bytes of a SHA-256 of role and text, then the text's length), and
texts aren't shuffled. A conversation is cut into blocks of WIDTH turns with a column each. One
ROLLUP over those positional columns, grouped by the node where the block before it ended,
aggregates the prefixes of all lengths together; grouping_id gives a row's depth in its block. A
node is named by a chained digest of its path, so blocks of long conversations need no rounds.

What a subtree holds follows from sums over its conversations. A node belongs to its least member,
so each conversation owns the end of its path from some depth on. With Q(c) for the code points of
c's path above what it owns and P for those above a node's own turn, the node's subtree saves
sum(Q) - min(Q) - (members - 1) * P; its childless nodes are counted at their owners.

Odd input: rows without conv_id belong to no conversation and are left out; a null role or text is
empty; turns with equal numbers go in the order of their ids; repeated rows are turns of their own;
an empty table gives no nodes; other columns, whatever their names, are ignored. A conversation may
hold a large part of all rows: positions come from a range sort and an offset a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import Scratch, materialize, ship_package

WIDTH = 8  # turns a block
ID_BYTES = 16
TURN_BYTES = 20  # an id and four bytes of length
ROOT = bytes(ID_BYTES)
CHUNK = 1 << 16  # characters of joined ids in a row
HEAD = 5  # turns that a rebuilt conversation takes from another one at most
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, ID_BYTES)


def turn_id(role: Column, text: Column) -> Column:
    size = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    return F.concat(digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), size)


def code_points(turn: Column) -> Column:
    """The length of a turn's text, which its id ends with; 0 for null."""
    return F.coalesce(F.conv(F.hex(F.substring(turn, ID_BYTES + 1, TURN_BYTES - ID_BYTES)), 16, 10).cast("long"), F.lit(0).cast("long"))


def identified(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tid and, for looking texts up, role and text (null as empty)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(role, text).alias("tid"), role.alias("role"), text.alias("text"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and tid of turns, ordered by turn (null first) and tid, for conversations of any size.

    Turns are range-partitioned, so a long conversation lies in several partitions; each numbers its
    own, and a partition's first conversation gets what earlier partitions hold of it.
    """
    order = ["conv_id", "turn", "tid"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            convs = batch.column(0).to_numpy()
            if not len(convs):
                continue
            first = np.flatnonzero(np.diff(convs, prepend=convs[0] - 1))
            counts = np.diff(first, append=len(convs))
            at = np.arange(1, len(convs) + 1) - np.repeat(first, counts)
            if convs[0] == last:
                at[: counts[0]] += seen
            last, seen = convs[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(convs), part, np.int32)), pa.array(at), batch.column(1)], ["conv_id", "part", "at", "tid"])

    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "tid")
    found = materialize(dealt.mapInArrow(number, "conv_id long, part int, at long, tid binary"), "turns")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a partition at most: only a partition's first conversation begins in an earlier one.
    begun = found.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("begun", earlier).where("begun > 0").drop("n")
    return found.join(F.broadcast(begun), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("begun", F.lit(0))).alias("pos"), "tid")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations: conv_id, pos, tid and length; one of no turns has a row with null pos.

    The first h turns come from conversation c - c % 100 (all if fewer, none if absent), the rest are
    c's own after its first h, where h = crc32(c in decimal) % 6.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1))
    bases = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumn("h", head).withColumn("base", F.expr("conv_id - conv_id % 100")).join(bases, "base", "left")
    convs = convs.withColumn("b", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.expr("b + greatest(n - h, 0)"))
    convs = materialize(convs.select("conv_id", "base", "h", "b", "length"), "convs")
    rest = turns.join(convs, "conv_id").where("pos > h").select("conv_id", F.expr("pos - h + b").alias("pos"), "tid", "length")
    first = turns.where(f"conv_id % 100 = 0 and pos <= {HEAD}").select(F.col("conv_id").alias("base"), "pos", "tid")
    taken = first.join(convs, "base").where("pos <= b").select("conv_id", "pos", "tid", "length")
    bare = convs.where("length = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), "length")
    return rest.unionByName(taken).unionByName(bare)


def blocks_of(turns: DataFrame) -> DataFrame:
    """A row per block: conv_id, k, t1..tW, size (its code points), last, prior (the node before it) and prior_size."""
    spark = turns.sparkSession
    ship_package(spark)
    place = F.coalesce(F.col("pos") - 1, F.lit(0))
    dealt = turns.select("conv_id", "length", F.floor(place / WIDTH).alias("k"), F.struct(F.pmod(place, F.lit(WIDTH)).alias("slot"), "tid").alias("turn"))
    rows = dealt.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.min("length").alias("length"))  # at most WIDTH a group
    at = [F.get("turns", F.lit(i))["tid"] for i in range(WIDTH)]
    size = sum((code_points(t) for t in at[1:]), code_points(at[0]))
    rows = materialize(rows.select("conv_id", "k", *[t.alias(n) for t, n in zip(at, TURNS, strict=True)], size.alias("size"), (F.col("length") <= (F.col("k") + 1) * WIDTH).alias("last")), "blocks")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, above = ROOT, 0
        for batch in batches:
            priors, sizes = [], []
            for k, size, path in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                node, above = (ROOT, 0) if k == 0 else (node, above)
                priors.append(node)
                sizes.append(above)
                node, above = hashlib.sha256(node + path).digest()[:ID_BYTES], above + size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(priors, pa.binary()), pa.array(sizes, pa.int64())], ["conv_id", "k", "prior", "prior_size"])

    # The chain of a conversation is sequential; its blocks stream through one task in constant memory.
    later = rows.where("k > 0 or not last").select("conv_id", "k", "size", F.concat(*[F.coalesce(c, F.lit(b"")) for c in TURNS]).alias("path"))
    chained = later.repartition("conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(chain, "conv_id long, k long, prior binary, prior_size long")
    first = rows.where("k = 0 and last").withColumns({"prior": F.lit(ROOT), "prior_size": F.lit(0).cast("long")})
    return materialize(first.unionByName(rows.where("k > 0 or not last").join(chained, ["conv_id", "k"])), "chained")


def rolled_up(blocks: DataFrame, sums: str) -> DataFrame:
    """A row per node: key, parent, last (its turn), above (code points before that), depth and the given aggregates."""
    listed = ", ".join(TURNS)
    grouped = blocks.sparkSession.sql(
        f"""SELECT prior, {listed}, {WIDTH} - bit_count(grouping_id()) AS d, min(k) AS k, min(prior_size) AS prior_size, {sums}
            FROM {{blocks}} GROUP BY prior, ROLLUP({listed})""",
        blocks=blocks,
    )
    filled = sum((F.col(t).isNotNull().cast("int") for t in TURNS[1:]), F.col(TURNS[0]).isNotNull().cast("int"))
    # A conversation that ends inside its block has null columns: their levels are no prefixes.
    nodes = grouped.where((F.col("d") == filled) & ((F.col("d") > 0) | (F.col("k") == 0)))
    path = F.concat("prior", *[F.coalesce(t, F.lit(b"")) for t in TURNS])
    size = sum((code_points(F.col(t)) for t in TURNS[1:]), code_points(F.col(TURNS[0])))
    last = F.coalesce(*reversed(TURNS))
    parent = F.when(F.col("d") == 1, F.col("prior")).when(F.col("d") > 1, digest(F.expr("substring(path, 1, octet_length(path) - %d)" % TURN_BYTES)))
    made = {"key": F.when(F.col("d") == 0, F.col("prior")).otherwise(digest(F.col("path"))), "parent": parent, "last": last, "depth": F.col("k") * WIDTH + F.col("d"), "above": F.col("prior_size") + size - code_points(last)}
    return nodes.withColumn("path", path).withColumns(made).drop("path", "prior", "prior_size", "d", "k", *TURNS)


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of (key, conv_id): the hash of the sorted ids, joined by commas.

    Ids are sorted by ranges and joined to chunks in parallel, so a key of any size spreads; the
    hash, sequential by its definition, takes a key's chunks as a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "ids"]
        key, ids, length = None, [], 0
        for batch in batches:
            out = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or length > CHUNK):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids, length = [], 0
                key = k
                ids.append(conv)
                length += 10
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out])], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    chunks = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie over (conv_id, pos, tid, length): key, parent, last, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = blocks_of(turns)
    nodes = materialize(rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    counted = materialize(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    owned = counted.groupBy("conv_id").agg(F.sum(code_points(F.col("last"))).alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sizes = blocks.groupBy("conv_id").agg(F.sum("size").alias("whole"))
    facts = sizes.join(owned, "conv_id", "left").select("conv_id", F.expr("whole - coalesce(owned, 0) as q"), F.expr("coalesce(leaf, 0) as leaf"))
    sums = rolled_up(blocks.join(facts, "conv_id"), "sum(q) AS q, min(q) AS least_q, sum(leaf) AS n_leaves").select("key", "q", "least_q", "n_leaves")
    path = F.concat("prior", *[F.coalesce(t, F.lit(b"")) for t in TURNS])
    ends = end_digests(blocks.where("last").select(F.when(F.col("t1").isNull(), F.col("prior")).otherwise(digest(path)).alias("key"), "conv_id"))
    above = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = counted.join(sums, "key").join(ends, "key", "left").join(above, "parent", "left")
    saved = F.col("q") - F.col("least_q") - (F.col("n_convs") - 1) * F.col("above")
    return whole.withColumns({"saved_tokens": saved, "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}).drop("q", "least_q", "above")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_prefixes(conversations: DataFrame, shared_heads: bool = True, with_text: bool = False) -> DataFrame:
    """The nodes of all conversations' trie (see trie), of the rebuilt ones with shared_heads; with_text adds the last turn's role and text."""
    turns = identified(conversations)
    with Scratch() as scratch:
        placed = numbered(materialize(turns.select("conv_id", "turn", "tid"), "ids"))
        if shared_heads:
            placed = with_shared_heads(placed)
        else:
            placed = placed.join(placed.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id")
        nodes = scratch.keep(materialize(trie(placed), "trie"))
    if with_text:
        texts = turns.groupBy(F.col("tid").alias("last")).agg(F.min("role").alias("role"), F.min("text").alias("text"))
        nodes = nodes.join(texts, "last", "left")
    return nodes


def duckdb_sql() -> str:
    """The rows of the query over the rebuilt conversations, by lists of whole turns."""
    return """
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns
  FROM src GROUP BY conv_id
), digits AS (
  SELECT conv_id, turns, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT) AS codes FROM own
), hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b: list_reduce(
    list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM digits
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, turns[1:d] AS path, len(turns) AS whole FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(length(path[d].text), 0) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '') AS ends
  FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
), below AS (
  SELECT path[1:a] AS path, sum((n - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
