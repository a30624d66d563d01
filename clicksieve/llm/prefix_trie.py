"""Prefix trie of conversations with a splitter skeleton.

A conversation is the path of its turns. Each turn is one 16-byte digest, so a
path is a byte string whose order keeps all conversations with a common
beginning together. Conversations are dealt into shards by ranges of (path,
id), so that many equal ones are cut as well, and sorted inside each shard.

A node whose conversations lie in more than one shard is a prefix of the path
of a splitter between two shards. The trie of the splitters' paths, the
skeleton, is sent to all tasks. A task walks over its sorted shard with one
open node per level: nodes outside the skeleton are complete when the walk
leaves them, skeleton nodes give what this shard knows of them. These parts
are added up per node, and the last step, from the leaves of the skeleton
upwards, works on the skeleton alone.

The skeleton has at most ``MAX_DEPTH`` nodes per shard, whatever the table
holds, and its size is what is broadcast and what reaches the driver.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

WIDTH = 16  # bytes of a turn's digest
TURNS_PER_SHARD = 1_000_000
MAX_DEPTH = 1000  # turns of a splitter's path; longer ones are cut, which moves the bound a little
SAMPLED = 20  # conversations per shard that splitters are chosen from, about
PIECE = 1 << 20  # bytes of a list of ids that a shard hands on at a time
OUT_ROWS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (turn, digest, chars).

    The digest is of role and text; only it and the length of the text travel.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn"), F.substring(F.sha2(said, 256), 1, 2 * WIDTH).alias("digest"), F.char_length(text).alias("chars")
    )
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def spliced(turns: DataFrame, longest: int = 5) -> DataFrame:
    """Each conversation's beginning replaced by that of the first of its hundred.

    How much is replaced, up to ``longest`` turns, follows from a hash of the
    id. Without the first of a hundred, the beginning is only taken away.
    """
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    heads = turns.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, longest).alias("_head")
    )
    head = F.slice(F.coalesce(F.col("_head"), F.array().cast(turns.schema["turns"].dataType)), F.lit(1), cut)
    rest = F.slice("turns", cut + 1, F.size("turns"))
    return turns.join(heads, base == F.col("_base"), "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _splitters(rows: DataFrame, shards: int, total: int) -> list[tuple[bytes, int]]:
    """Bounds between shards from a sample by hash: about ``SAMPLED`` a shard, cut to ``MAX_DEPTH`` turns."""
    rate = min(1.0, SAMPLED * shards / max(total, 1))
    drawn = F.pmod(F.xxhash64("conv_id", F.lit(23)), F.lit(1_000_000)) < int(rate * 1_000_000) + 1
    sample = rows.where(drawn).select(F.substring("path", 1, WIDTH * MAX_DEPTH).alias("path"), "conv_id").collect()
    ordered = sorted((bytes(r.path), r.conv_id) for r in sample)
    if not ordered:
        return []
    return sorted({ordered[len(ordered) * s // shards] for s in range(1, shards)})


class Skeleton:
    """Trie of the splitters' paths; node 0 is the root, parents have smaller numbers."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent = [-1]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), WIDTH):
                key = (node, path[at : at + WIDTH])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                node = self.child[key]


FINISHED, PART, ENDS = 0, 1, 2
_WALKED = (
    "kind int, node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, chars long, shard int, piece int, ids string"
)
_NAMES = [c.split()[0] for c in _WALKED.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_SHAPE = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _WALKED.split(", ")])


class _Open:
    """A node on the current path, with what is known of its conversations so far."""

    __slots__ = ("digest", "node", "slot", "chars", "least", "n", "children", "leaves", "saved", "ends", "pieces")

    def __init__(self, digest: bytes, node: int, slot: int, chars: int):
        self.digest, self.node, self.slot, self.chars = digest, node, slot, chars
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pieces = None, 0


class _Walk:
    """One pass over conversations sorted by (shard, path, id)."""

    def __init__(self, child: dict[tuple[int, bytes], int]):
        self.child = child
        self.shard = None
        self.open: list[_Open] = []
        self.done: list[tuple] = []  # complete rows
        self.waiting: list[tuple] = []  # rows of nodes whose parent is still open
        self.least_of: list[int] = []  # per slot, of nodes outside the skeleton that were opened since all were closed

    def add(self, shard: int, conv_id: int, path: bytes, chars: list[int]) -> None:
        if shard != self.shard:
            self.end()
            self.shard = shard
            self.open = [_Open(b"", 0, -1, 0)]
        depth, shared = len(path) // WIDTH, 0
        digests = [path[at : at + WIDTH] for at in range(0, len(path), WIDTH)]
        limit = min(depth, len(self.open) - 1)
        while shared < limit and self.open[shared + 1].digest == digests[shared]:
            shared += 1
        while len(self.open) - 1 > shared:
            self.close()
        for at in range(shared, depth):
            above = self.open[-1]
            node = self.child.get((above.node, digests[at]), -1) if above.node >= 0 else -1
            slot = -1
            if node < 0:
                slot = len(self.least_of)
                self.least_of.append(0)
            self.open.append(_Open(digests[at], node, slot, chars[at]))
        top = self.open[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        said = str(conv_id)
        if top.node < 0:
            if top.ends is None:
                top.ends = hashlib.sha256(said.encode())
            else:
                top.ends.update(b"," + said.encode())
        else:
            if top.ends is None:
                top.ends = []
            top.ends.append(said)
            if len(top.ends) >= PIECE // 16:
                self.hand_on(top)

    def hand_on(self, node: _Open) -> None:
        """Ids that end at a skeleton node, as far as this shard knows, in order."""
        self.done.append((ENDS, node.node, *[None] * 9, self.shard, node.pieces, ",".join(node.ends)))
        node.pieces += 1
        node.ends = None

    def close(self) -> None:
        done = self.open.pop()
        above = self.open[-1] if self.open else None
        if done.node >= 0:
            if done.ends:
                self.hand_on(done)
            self.done.append((
                PART, done.node, done.least, len(self.open), None, done.n, done.children, done.leaves, done.saved, None, done.chars,
                None, None, None,
            ))
        else:
            done.leaves = done.leaves or 1
            done.saved += (done.n - 1) * done.chars
            self.least_of[done.slot] = done.least
            self.waiting.append((
                above.slot, above.node, done.least, len(self.open), done.n, done.children, done.leaves, done.saved,
                done.ends.hexdigest() if done.ends else NOTHING,
            ))
            above.children += 1
        if above is not None:
            above.n += done.n
            above.least = done.least if above.least is None else min(above.least, done.least)
            above.leaves += done.leaves
            above.saved += done.saved
            if above.node >= 0 and done.node < 0:
                self.resolve()

    def resolve(self) -> None:
        """All nodes outside the skeleton are closed: their rows can name their parents."""
        for slot, node, least, depth, n, children, leaves, saved, ends in self.waiting:
            parent = self.least_of[slot] if slot >= 0 else None
            self.done.append((FINISHED, node, least, depth, parent, n, children, leaves, saved, ends, None, None, None, None))
        self.waiting.clear()
        self.least_of.clear()

    def end(self) -> None:
        while self.open:
            self.close()

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while self.done and len(self.done) >= least:
            part, self.done = self.done[:OUT_ROWS], self.done[OUT_ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _SHAPE)], schema=_SHAPE)


def _walked(rows: DataFrame, splitters: list[tuple[bytes, int]], skeleton: Skeleton, shards: int) -> DataFrame:
    child = skeleton.child

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(splitters, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walked = _Walk(child)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for row in zip(*(part.column(c).to_pylist() for c in ("shard", "conv_id", "path", "chars"))):
                    walked.add(*row)
                yield from walked.batches(OUT_ROWS)
        walked.end()
        yield from walked.batches(1)

    placed = rows.mapInArrow(dealt, "shard int, conv_id long, path binary, chars array<int>")
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return ordered.mapInArrow(walk, _WALKED)


def _joined_ends(walked: DataFrame) -> DataFrame:
    """Digests of the ids that end at skeleton nodes. A digest is a chain, so each list passes one task, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            for number, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
                if number != node:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "ends_sha256": [digest.hexdigest()]})
                    node, digest = number, hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "ends_sha256": [digest.hexdigest()]})

    pieces = walked.where(F.col("kind") == ENDS).select("node", "shard", "piece", "ids")
    return pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").mapInArrow(run, "node int, ends_sha256 string")


_NODE = "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _reduced(walked: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes: parts added up by Spark, then from its leaves upwards on its own few nodes."""
    parts = walked.where(F.col("kind") == PART).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    ).collect()
    known = {r.node: r for r in parts}
    children, leaves, saved = ({r.node: r[c] for r in parts} for c in ("n_children", "n_leaves", "saved_tokens"))
    # what a node adds to itself and to all above it is only known when its own sum is
    more_leaves, more_saved = dict.fromkeys(known, 0), dict.fromkeys(known, 0)
    rows = []
    for node in sorted(known, reverse=True):
        r, parent = known[node], skeleton.parent[node]
        more_leaves[node] += 0 if children[node] else 1
        more_saved[node] += (r.n_convs - 1) * r.chars
        if parent >= 0:
            children[parent] += 1
            more_leaves[parent] += more_leaves[node]
            more_saved[parent] += more_saved[node]
        rows.append((
            node, r.conv_id, r.depth, known[parent].conv_id if parent >= 0 else None, r.n_convs, children[node],
            leaves[node] + more_leaves[node], saved[node] + more_saved[node],
        ))
    return walked.sparkSession.createDataFrame(rows, _NODE)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turns); see ``prefix_trie``."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    chars: Column = F.transform("turns", lambda t: t["chars"])
    rows = staged(turns.select("conv_id", path.alias("path"), chars.alias("chars")), "trie-paths")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("chars")), F.lit(0)).alias("turns")).first()
    if shards is None:
        least = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(least, -(-size.turns // TURNS_PER_SHARD))
    splitters = _splitters(rows, shards, size.n)
    skeleton = Skeleton(splitters)
    walked = staged(_walked(rows, splitters, skeleton, len(splitters) + 1), "trie-walked")
    top = _reduced(walked, skeleton)
    ends = F.coalesce(F.col("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256")
    upper = top.join(_joined_ends(walked), "node", "left").select(*COLUMNS[:-1], ends)
    # the parent of a finished node is either in its own shard or in the skeleton, whose size is bounded
    parents = F.broadcast(top.select("node", F.col("conv_id").alias("_parent")))
    finished = walked.where(F.col("kind") == FINISHED).join(parents, "node", "left")
    lower = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*COLUMNS)
    return lower.unionByName(upper)


def prefix_trie(conversations: DataFrame, splice: bool = False, shards: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of conversations (conv_id, turn, role, text).

    A conversation is its turns (role, text; null counts as empty) by ``turn``,
    null first; turns of one number are ordered by a digest of role and text.
    A node stands for a distinct sequence of first turns; its members are the
    conversations that begin so, and the root, without turns, has all. Columns:
    ``conv_id`` (smallest member; with ``depth`` it names the node), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes in the subtree, the node
    included), ``saved_tokens`` (code points that need not be stored again:
    over the subtree, (members - 1) times the length of each last text),
    ``ends_sha256`` (digest of the ids, ascending and comma-joined, of members
    without further turns). ``splice`` replaces the beginnings, see ``spliced``.

    Rows without conv_id are no conversation's. Repeated rows are turns said
    twice. Without conversations there is no node. A conversation is one row of
    20 bytes a turn and its turns are gathered by one task; texts stay behind.
    """
    turns = paths(conversations.select("conv_id", "turn", "role", "text"))
    return trie(spliced(turns) if splice else turns, shards)


def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"), splice=True)


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (
      PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
    ) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: list_reduce(
      list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)
    )
  )) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), rebuilt AS (
  SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL
  SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, length(text) AS chars
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
  UNION ALL
  SELECT conv_id, 0, []::STRUCT(role VARCHAR, text VARCHAR)[], 0 FROM c
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars FROM prefixes GROUP BY path
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes) WHERE last GROUP BY path
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)
), subtrees AS (
  SELECT list_slice(path, 1, above) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted n JOIN subtrees USING (path) LEFT JOIN ends USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
