"""Prefix trie of conversations: which openings they share, and what sharing them saves.

Every conversation is a sequence of turns, each known by a digest of role and text. Sequences are sorted over the cluster
and cut into range shards, so that the conversations below any node are neighbours. A shard numbers its turns through a
dictionary and keeps its sequences in a ternary search tree, into which they go median first, so that the choices at
each depth are balanced. One backward sweep over the nodes, which come after their parents, sums up members, children,
leaves and savings. Nodes on the way to a shard's first or last sequence may go on in the shard beside it: they are merged by
the digest of their path, and what neighbours counted twice is taken off with the common prefix of the two sequences at each border.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import settle

DIGEST = 16  # bytes of a turn's or a path's digest
SHARD_TURNS = 1_000_000  # turns in a shard, about
ENDS_CHUNK = 4_096  # ids in one piece of the members that end at a border node
_BATCH = 20_000
_NO_ENDS = hashlib.sha256(b"").hexdigest()

TURN = "array<struct<digest:binary,length:bigint>>"
SEQUENCES = "conv_id bigint, path binary, lengths array<bigint>"
_PART = (
    "kind string, shard int, path binary, parent_path binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, lengths array<bigint>, place bigint, ids string"
)
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("path", pa.binary()), ("parent_path", pa.binary()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("lengths", pa.list_(pa.int64())), ("place", pa.int64()), ("ids", pa.string()),
])
_FIXED = "path binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_digest(role: Column, text: Column) -> Column:
    """First half of the SHA-256 of role and text; the length of the role keeps the two apart."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(both, 256), 1, 2 * DIGEST))


def turns_by_conversation(conversations: DataFrame, group: Column) -> DataFrame:
    """``group``, ``conv_id``, ``turns`` in order; texts are read once and go no further than their digest.

    Conversations of one ``group`` come to one task, turn by turn without their texts. Turns order by ``turn``, a missing one first, equal
    ones by digest. A missing role or text counts as empty. Rows without ``conv_id`` belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        group.alias("group"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        turn_digest(role, text).alias("digest"), F.length(text).cast("bigint").alias("length"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "length")))
    lists = turns.repartition(parts, "group").groupBy("group", "conv_id").agg(ordered.alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"], t["length"])))


def sequences_of(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (digests of all turns in a row) and ``lengths`` of the turns' texts."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["length"]).alias("lengths"))


def with_shared_openings(conversations: DataFrame, group_size: int = 100, longest: int = 6) -> DataFrame:
    """Sequences of conversations rebuilt with the opening of their group's first conversation.

    Conversation c begins with the first h turns of conversation c - c % ``group_size`` (all if it has fewer, none if it is absent) and goes
    on with its own turns after the first h; h is the CRC-32 of c in decimals, modulo ``longest``. Remainders carry the
    sign of c.
    """
    base = F.col("conv_id").cast("bigint") - F.col("conv_id").cast("bigint") % group_size
    lists = turns_by_conversation(conversations, base)
    head = F.slice("turns", 1, longest - 1)
    opened = lists.withColumn("head", F.max(F.when(F.col("conv_id") == F.col("group"), head)).over(Window.partitionBy("group")))
    taken = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    opening = F.slice(F.coalesce("head", F.array().cast(TURN)), F.lit(1), taken)
    rest = F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1)))
    return sequences_of(opened.select("conv_id", F.concat(opening, rest).alias("turns")))


def _path_keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, … ``depth`` turns, each made from the one before."""
    keys = [bytes(DIGEST)]
    for at in range(depth):
        keys.append(hashlib.sha256(keys[-1] + path[at * DIGEST : (at + 1) * DIGEST]).digest()[:DIGEST])
    return keys


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at the front."""
    turns = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, np.uint8, turns * DIGEST) for p in (a, b))
    differs = np.flatnonzero(x != y)
    return int(differs[0]) // DIGEST if len(differs) else turns


class _Dictionary:
    """Numbers the distinct digests of a shard in their byte order."""

    def __init__(self, digests: bytes) -> None:
        halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        steps = np.any(halves[order][1:] != halves[order][:-1], axis=1)
        ids = np.empty(len(order), np.int64)
        ids[order] = np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(steps)])
        self.ids = ids


class _Tree:
    """Ternary search tree over numbered turns; node 0 is the root of the trie, which has no turn."""

    def __init__(self) -> None:
        self.turn, self.below, self.above, self.inner = (array("q", [0]) for _ in range(4))
        self.parent, self.depth, self.length = (array("q", [0]) for _ in range(3))

    def _node(self, turn: int, parent: int, length: int) -> int:
        for column, value in (
            (self.turn, turn), (self.below, 0), (self.above, 0), (self.inner, 0),
            (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.length, length),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], lengths: array) -> int:
        """The node at which the sequence ends; missing nodes are added."""
        at, turn_of, below, above, inner = 0, self.turn, self.below, self.above, self.inner
        for place, turn in enumerate(turns):
            node = inner[at]
            if not node:
                node = inner[at] = self._node(turn, at, lengths[place])
            while turn_of[node] != turn:
                side = below if turn < turn_of[node] else above
                if not side[node]:
                    side[node] = self._node(turn, at, lengths[place])
                node = side[node]
            at = node
        return at


def _medians(count: int) -> Iterator[int]:
    """All places below ``count``, the middle one first, then the middles of both halves, and so on."""
    waiting = deque([(0, count)])
    while waiting:
        low, high = waiting.popleft()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting.append((low, middle))
            waiting.append((middle + 1, high))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard's tree; its first and last sequences; and the members that end at its border nodes, in pieces."""
    number, conv_ids, paths, lengths = TaskContext.get().partitionId(), array("q"), [], array("q")
    starts, offsets = [], [0]  # of each distinct sequence: its first member, its first turn
    for batch in batches:
        sizes = batch.column("lengths")
        ends, values = sizes.offsets.to_numpy(), sizes.values.to_numpy()
        for row, (conv_id, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist())):
            if not paths or paths[-1] != path:
                starts.append(len(conv_ids))
                paths.append(path)
                lengths.frombytes(values[ends[row] : ends[row + 1]].tobytes())
                offsets.append(len(lengths))
            conv_ids.append(conv_id)
    if not paths:
        return
    starts.append(len(conv_ids))
    ids, members, tree = _Dictionary(b"".join(paths)).ids, np.frombuffer(conv_ids, np.int64), _Tree()
    ends = {}
    for place in _medians(len(paths)):
        turns = slice(offsets[place], offsets[place + 1])
        ends[tree.insert(ids[turns].tolist(), lengths[turns])] = place

    def path_nodes(place: int) -> list[int]:
        node, way = next(n for n, p in ends.items() if p == place), []
        while node:
            way.append(node)
            node = tree.parent[node]
        return [0, *way[::-1]]

    border: dict[int, bytes] = {}
    for place in (0, len(paths) - 1):
        border |= dict(zip(path_nodes(place), _path_keys(paths[place], len(paths[place]) // DIGEST)))

    size = len(tree.turn)
    first, n_convs, n_children, n_leaves, saved = (array("q", bytes(8 * size)) for _ in range(5))
    hashes: dict[int, str] = {}
    for node, place in ends.items():
        own = members[starts[place] : starts[place + 1]]
        n_convs[node], first[node] = len(own), int(own[0])
        if node not in border:
            hashes[node] = hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest()
    known = bytearray(size)
    for node in ends:
        known[node] = 1
    for node in range(size - 1, -1, -1):
        n_leaves[node] += not n_children[node]
        saved[node] += (n_convs[node] - 1) * tree.length[node]
        if node:
            up = tree.parent[node]
            first[up] = min(first[up], first[node]) if known[up] else first[node]
            known[up] = 1
            n_convs[up] += n_convs[node]
            n_children[up] += 1
            n_leaves[up] += n_leaves[node]
            saved[up] += saved[node]

    def rows(**columns) -> pa.RecordBatch:
        count = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _SCHEMA], schema=_SCHEMA
        )

    for start in range(0, size, _BATCH):
        some = range(start, min(start + _BATCH, size))
        yield rows(
            kind=["border" if n in border else "node" for n in some], shard=[number] * len(some), path=[border.get(n) for n in some],
            parent_path=[border.get(tree.parent[n]) if n else None for n in some], conv_id=[first[n] for n in some],
            depth=[tree.depth[n] for n in some], parent_conv_id=[first[tree.parent[n]] if n else None for n in some],
            n_convs=[n_convs[n] for n in some], n_children=[n_children[n] for n in some], n_leaves=[n_leaves[n] for n in some],
            saved_tokens=[saved[n] for n in some], ends_sha256=[hashes.get(n, _NO_ENDS) for n in some],
        )
    both = (0, len(paths) - 1)
    yield rows(kind=["first", "last"], shard=[number] * 2, path=[paths[p] for p in both], lengths=[lengths[offsets[p] : offsets[p + 1]] for p in both])
    for node in border:
        if node in ends:
            low, high = starts[ends[node]], starts[ends[node] + 1]
            for start in range(low, high, ENDS_CHUNK):
                text = ",".join(map(str, members[start : min(start + ENDS_CHUNK, high)].tolist()))
                yield rows(kind=["ends"], shard=[number], path=[border[node]], place=[start], ids=[text])


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the two shards of a border counted twice, per node that both have.

    Nodes up to the common depth of the sequences beside the border are in both. Of each, the shards together have
    counted one member too few in the savings of every turn from it to that depth, and one child too many above that depth.
    If the left shard's last sequence ends at that depth, its leaf goes on, or is counted again, on the right.
    """
    for batch in batches:
        out = [[] for _ in range(6)]
        for left, lengths, right in zip(*(batch.column(c).to_pylist() for c in ("left", "lengths", "right"))):
            depth = _common(left, right)
            keys, below = _path_keys(left, depth), 0
            ended = len(lengths) == depth
            for at in range(depth, -1, -1):
                below += lengths[at - 1] if at else 0
                for column, value in zip(out, (keys[at], None, 0, -1 if at < depth else 0, -1 if ended else 0, below)):
                    column.append(value)
        kinds = [pa.binary(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["path", "conv_id", *_SUMS])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the members that end at each border node; their pieces come in order and are not held."""
    path, running = None, hashlib.sha256()
    done: tuple[list, list] = ([], [])
    for batch in batches:
        for key, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
            if key != path:
                if path is not None:
                    done[0].append(path)
                    done[1].append(running.hexdigest())
                path, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if path is not None:
        done[0].append(path)
        done[1].append(running.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["path", "ends_sha256"])


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of ``sequences`` (see ``sequences_of``), the empty one included.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` the parent's smallest member (null at depth 0), ``n_convs`` members,
    ``n_children``, ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` the subtree's sum of (members - 1) times the length of the
    last turn's text, ``ends_sha256`` of the comma-joined ids of the members that end there. No conversations: no rows. Copies of any number
    are spread over shards, as ids take part in the sort; a task holds a shard, which is bounded but for the digests of its longest
    sequence. Ids must be distinct.
    """
    spark, stored = sequences.sparkSession, settle(sequences)
    turns = stored.agg(F.sum(F.size("lengths") + 1)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(turns / shard_turns))
    sharded = stored.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = settle(sharded.select("conv_id", "path", "lengths").mapInArrow(_shard, _PART))

    # Shards that hold something follow each other; one row per shard meets in a task.
    firsts, lasts = (
        parts.filter(F.col("kind") == kind).select("shard", F.col("path").alias(side), *more)
        for kind, side, more in (("first", "right", []), ("last", "left", ["lengths"]))
    )
    order = firsts.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before")).filter("before is not null")
    borders = order.join(firsts, "shard").join(lasts.withColumnRenamed("shard", "before"), "before").select("left", "lengths", "right")
    twice = borders.mapInArrow(_twice, _FIXED)

    own = parts.filter("kind = 'border'")
    sums = own.select("path", "conv_id", *_SUMS).unionByName(twice).groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    pieces = parts.filter("kind = 'ends'").select("path", "shard", "place", "ids")
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "shard", "place")
    ends = pieces.select("path", "ids").mapInArrow(_hash_ends, "path binary, ends_sha256 string")
    where = own.groupBy("path").agg(F.min("depth").alias("depth"), F.min("parent_path").alias("parent_path"))
    merged = settle(sums.join(where, "path").join(ends, "path", "left").fillna(_NO_ENDS, ["ends_sha256"]))
    parents = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(parents, "parent_path", "left").select(*NODES)

    # Nodes below a border node learn its smallest member by shard, so that the root's children are no hot group.
    inner = parts.filter("kind = 'node'")
    named = own.select("shard", "path").join(merged.select("path", F.col("conv_id").alias("merged_id")), "path")
    named = named.withColumnRenamed("path", "parent_path")
    below = inner.filter("parent_path is not null").join(named, ["shard", "parent_path"]).withColumn("parent_conv_id", F.col("merged_id"))
    return inner.filter("parent_path is null").select(*NODES).unionByName(below.select(*NODES)).unionByName(top)


# Rebuilt conversations and their nodes in standard SQL; CRC-32 is computed bit by bit.
SQL = """
with c as (select conv_id, conv_id - conv_id % 100 as base, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
 from conversations where conv_id is not null),
ids as (select distinct conv_id, base from c),
h as (select conv_id, base, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(cast(conv_id as varchar)) + 1),
   lambda i: cast(ord(substr(cast(conv_id as varchar), i, 1)) as bigint))),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
   lambda x, _z: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 6 as h from ids),
r as (select h.conv_id, c.place, c.role, c.text from h join c on c.conv_id = h.base and c.place <= h.h
 union all select h.conv_id, c.place + 1000000, c.role, c.text from h join c on c.conv_id = h.conv_id and c.place > h.h),
t as (select conv_id, row_number() over (partition by conv_id order by place) as depth, length(text) as n,
  sha256(length(role) || ':' || role || text) as digest from r),
p as (select conv_id, depth, n, sha256(string_agg(digest, '') over (partition by conv_id order by depth)) as path,
  count(*) over (partition by conv_id) as turns from t
 union all select ids.conv_id, 0, 0, '', (select count(*) from t where t.conv_id = ids.conv_id) from ids),
nodes as (select path, depth, min(n) as n, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where turns = depth), '')) as ends_sha256
 from p group by 1, 2),
up as (select n.path, min(q.path) as parent_path from nodes n join p on p.path = n.path join p q on q.conv_id = p.conv_id and q.depth = n.depth - 1 group by 1),
kids as (select parent_path, count(*) as n_children from up group by 1),
sub as (select top.path, sum((low.n_convs - 1) * low.n) as saved, sum(case when k.n_children is null then 1 else 0 end) as n_leaves
 from nodes low left join kids k on k.parent_path = low.path
 join p on p.path = low.path and p.conv_id = low.conv_id join p top on top.conv_id = low.conv_id and top.depth <= low.depth group by 1)
select n.conv_id, n.depth, a.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, cast(s.n_leaves as bigint) as n_leaves,
 cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n left join up on up.path = n.path left join nodes a on a.path = up.parent_path left join kids k on k.parent_path = n.path
join sub s on s.path = n.path"""
