"""Conversation prefix trie by whole-sequence collapse (operator 11).

A trie of conversations, where a depth-d node is a distinct sequence of the first ``d`` turns:

1. ``rebuild`` derives conversations that share openings: the first ``h`` turns of the
   conversation at the head of each group of five, then the own turns after the first ``h``.
   Rows are dealt by group and sorted, so the turns stream past; a task holds at most the
   head's first eight turns.
2. ``paths`` streams the turns of each conversation once more and gives one row per prefix: its key (a
   chained 256-bit digest), its parent's key and the bytes so far.
3. ``sequences`` groups identical conversations into one weighted sequence with its end list.
   The list is digested in sorted order: ids are range-partitioned by (sequence, id), so a sequence
   that a third of all conversations share is cut into blocks of ids, and only the blocks meet.
4. Sequences that are proper prefixes of others go by anti-join; the rest are the leaves.
5. ``trie`` adds up weights, smallest members and leaves of all prefixes of the distinct
   sequences.  Every node belongs to one leaf (the smallest through it); along a leaf's path its own
   nodes are the lower end, so bytes of distinct nodes below a node are sums over leaves as well.

All sums per node are partial aggregates, and joins that may meet a hot parent or a very long
conversation are salted (``common.spread_join``), so the root's children are nobody's single group.

Edge cases: NULL role or text is empty; NULL turns come first; rows that tie in ``turn`` go by
role, then text; repeated rows are turns of their own; rows without ``conv_id`` belong to no
conversation and are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join

GROUP, SPAN = 5, 9
REBUILT_SCHEMA = "conv_id long, pos long, role string, text string"
PATH_SCHEMA = ("conv_id long, depth long, key binary, parent binary, bytes long, total long, is_end boolean")
ROOT = hashlib.sha256(b"root").digest()
EMPTY = hashlib.sha256(b"").hexdigest()
#: conversation ids of one sequence that are joined to one block
BLOCK = 8192
_BATCH = 4096


def shared_turns(conv_id: int, span: int = SPAN) -> int:
    """How many turns a conversation takes from the head of its group."""
    return zlib.crc32(str(conv_id).encode()) % span


def _turns(conversations: DataFrame) -> DataFrame:
    empty = F.lit("")
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                    F.coalesce(F.col("text").cast("string"), empty).alias("text")))


def _stream(batches):
    """Rows of record batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def _batches(rows, schema: pa.Schema, limit: int = 1 << 24):
    """Record batches of bounded rows and bytes from a stream of tuples."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(part) >= _BATCH or size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def rebuild(conversations: DataFrame, group: int = GROUP, span: int = SPAN) -> DataFrame:
    """``conv_id, pos, role, text``: turns of the rebuilt conversations from ``pos`` 1 on.

    A conversation without turns is one row with ``pos`` 0 and NULL role and text.
    """
    rows = (_turns(conversations)
            .withColumn("head", F.col("conv_id") - F.col("conv_id") % group)
            .withColumn("own", F.col("conv_id") != F.col("head")))
    order = ["head", "own", "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition("head").sortWithinPartitions(*order).select("head", "conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def turns(stream):
        for head, of_head in groupby(stream, key=lambda r: r[0]):
            opening = []
            for conv_id, own in groupby(of_head, key=lambda r: r[1]):
                skip = shared_turns(conv_id, span)
                pos = 0
                if conv_id != head:
                    for role, text in opening[:skip]:
                        pos += 1
                        yield conv_id, pos, role, text
                for i, (_, _, role, text) in enumerate(own):
                    if conv_id == head:
                        if i < span - 1:
                            opening.append((role, text))
                    elif i < skip:
                        continue
                    pos += 1
                    yield conv_id, pos, role, text
                if not pos:
                    yield conv_id, 0, None, None

    def run(batches):
        yield from _batches(turns(_stream(batches)), schema)

    return dealt.mapInArrow(run, REBUILT_SCHEMA)


def paths(rebuilt: DataFrame) -> DataFrame:
    """One row per prefix of every conversation, the root included.

    ``key`` and ``parent`` digest the prefixes with and without the last turn; ``bytes`` are the UTF-8
    bytes of its last text, ``total`` those of all its texts; ``is_end``: the whole conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()),
                        ("bytes", pa.int64()), ("total", pa.int64()), ("is_end", pa.bool_())])

    def prefixes(stream):
        for conv_id, turns in groupby(stream, key=lambda r: r[0]):
            depth, key, parent, size, total = 0, ROOT, None, 0, 0
            for _, pos, role, text in turns:
                if not pos:
                    continue
                yield conv_id, depth, key, parent, size, total, False
                role, text = role.encode("utf-8"), text.encode("utf-8")
                depth, parent, size = depth + 1, key, len(text)
                key = hashlib.sha256(key + len(role).to_bytes(8, "little") + role + text).digest()
                total += size
            yield conv_id, depth, key, parent, size, total, True

    def run(batches):
        yield from _batches(prefixes(_stream(batches)), schema)

    dealt = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.select("conv_id", "pos", "role", "text").mapInArrow(run, PATH_SCHEMA)


def end_lists(ends: DataFrame) -> DataFrame:
    """``key, weight, rep, ends_sha256``: per sequence its conversations' number, smallest id and digest.

    ``ends`` has ``key, conv_id``, one row per conversation.
    """
    blocks = pa.schema([("key", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    lists = pa.schema([("key", pa.binary()), ("weight", pa.int64()), ("rep", pa.int64()), ("ends_sha256", pa.string())])

    def cut(stream):
        for key, rows in groupby(stream, key=lambda r: r[0]):
            part = []
            for _, conv_id in rows:
                part.append(conv_id)
                if len(part) == BLOCK:
                    yield key, part[0], len(part), ",".join(map(str, part))
                    part = []
            if part:
                yield key, part[0], len(part), ",".join(map(str, part))

    def join(stream):
        for key, rows in groupby(stream, key=lambda r: r[0]):
            digest, weight, first = hashlib.sha256(), 0, None
            for _, rep, n, ids in rows:
                digest.update((b"," if weight else b"") + ids.encode())
                weight += n
                first = rep if first is None else first
            yield key, weight, first, digest.hexdigest()

    in_blocks = (ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                 .mapInArrow(lambda b: _batches(cut(_stream(b)), blocks), "key binary, rep long, n long, ids string"))
    return (in_blocks.repartition("key").sortWithinPartitions("key", "rep")
            .mapInArrow(lambda b: _batches(join(_stream(b)), lists), "key binary, weight long, rep long, ends_sha256 string"))


def sequences(path_rows: DataFrame) -> DataFrame:
    """Distinct sequences: ``key, weight, rep, ends_sha256, total, n_rows`` (prefixes), ``is_leaf``."""
    ends = path_rows.where("is_end")
    shape = ends.groupBy("key").agg(F.first("total").alias("total"), (F.first("depth") + 1).alias("n_rows"))
    collapsed = end_lists(ends).join(shape, "key")
    proper = path_rows.where(~F.col("is_end")).select("key").distinct()
    leaves = collapsed.join(proper, "key", "left_anti").select("key", F.lit(True).alias("is_leaf"))
    return collapsed.join(leaves, "key", "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rebuilt`` (``conv_id, pos, role, text``; see ``rebuild``).

    ``key, parent`` identify nodes; ``conv_id, depth`` find a node's turns again in ``rebuilt``.
    """
    every = scratch(paths(rebuilt), "trie-paths")
    whole = scratch(sequences(every), "trie-sequences")
    # prefixes of distinct sequences, told by the smallest conversation of each
    on_path = scratch(spread_join(every.drop("is_end"), whole.select(F.col("rep").alias("conv_id"), "weight", "is_leaf", "n_rows",
                                                                     F.col("total").alias("all_bytes")),
                                  ["conv_id"], weight="n_rows", spread=["depth"])
                      .withColumn("below", F.col("all_bytes") - F.col("total") + F.col("bytes")), "trie-prefixes")
    nodes = scratch(on_path.groupBy("key", "parent", "depth", "bytes", "total").agg(      # the key determines the others
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.min(F.when(F.col("is_leaf"), F.col("conv_id"))).alias("leaf"),
        F.sum(F.col("weight") * F.col("below")).alias("weighted")), "trie-nodes")

    # from which depth on a leaf's path is its own, and how many bytes that part has
    own = (nodes.groupBy("leaf").agg(F.min("depth").alias("own_depth"),
                                     F.min_by(F.col("total") - F.col("bytes"), "depth").alias("before"))
           .join(whole.where("is_leaf").select(F.col("rep").alias("leaf"), "n_rows", F.col("total").alias("all_bytes")), "leaf")
           .select(F.col("leaf").alias("conv_id"), "own_depth", (F.col("all_bytes") - F.col("before")).alias("own_bytes"), "n_rows"))
    own = scratch(own, "trie-leaves")
    distinct = (spread_join(on_path.where("is_leaf").select("conv_id", "depth", "key", "below"), own,
                            ["conv_id"], weight="n_rows", spread=["depth"])
                .groupBy("key").agg(F.sum(F.when(F.col("depth") >= F.col("own_depth"), F.col("below"))
                                          .otherwise(F.col("own_bytes"))).alias("once")))

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    found = (nodes.join(children, "key", "left").join(distinct, "key")
             .join(whole.select("key", "ends_sha256"), "key", "left")
             .select("key", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                     "n_leaves", (F.col("weighted") - F.col("once")).alias("saved_tokens"),
                     F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    found = scratch(found, "trie-found")
    parents = found.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("n_rows"))
    below_root = spread_join(found.where("parent IS NOT NULL"), parents, ["parent"], weight="n_rows", spread=["key"])
    root = found.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below_root.unionByName(root)


def node_turns(nodes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``nodes`` below the root with the ``role`` and ``text`` of their last turns."""
    last = rebuilt.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.where("depth > 0").join(last, ["conv_id", "depth"])


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations``."""
    return trie(rebuild(conversations))


#: the same in DuckDB: whole prefixes as group keys, subtrees by joining every node with its ancestors
SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: 0::BIGINT),
                          lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i))),
convs AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
shared AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS head,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {SPAN} AS h
  FROM convs, crc_table),
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                             ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT s.conv_id, CASE WHEN s.conv_id = s.head THEN o.turns ELSE coalesce(b.turns[1:s.h], []) || o.turns[s.h + 1:] END AS turns
  FROM shared s JOIN own o ON s.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = s.head),
prefixes AS (SELECT conv_id, d AS depth, turns[1:d] AS seq, d = len(turns) AS is_end
             FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
grouped AS (SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
            FROM prefixes GROUP BY seq, depth),
nodes AS (SELECT *, CASE WHEN depth > 0 THEN seq[1:depth - 1] END AS parent_seq,
                 CASE WHEN depth > 0 THEN strlen(seq[depth].text) ELSE 0 END AS bytes FROM grouped),
children AS (SELECT parent_seq, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent_seq),
marked AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent_seq = n.seq),
upward AS (SELECT seq[1:d] AS top, bytes, n_convs, n_children
           FROM (SELECT *, unnest(range(depth + 1)) AS d FROM marked)),
below AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
          FROM upward GROUP BY top)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves,
       b.saved_tokens, m.ends_sha256
FROM marked m JOIN below b ON b.top = m.seq LEFT JOIN nodes p ON p.seq = m.parent_seq
"""
