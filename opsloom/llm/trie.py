"""Prefix trie of conversations (operator 13) by a splitter skeleton.

A conversation is a path: its turns in order, a turn being a digest of role and text. Paths are dealt to shards by
range, between splitters drawn from a bounded sample of them. A prefix whose conversations lie in more than one shard is a prefix
of the splitter between them, so the trie of the splitter paths (the skeleton, broadcast) names every node that a shard
cannot finish alone. Each shard is sorted and read once: what is not in the skeleton is finished there, and for skeleton
nodes a shard gives partial aggregates, which are combined by key and added up from the ends of the skeleton to the root.

Ids of a path take part in the order, so a conversation with very many copies is cut as well. The skeleton is bounded by
``MOST_SHARDS`` paths of ``SKELETON_TURNS`` turns; where paths agree beyond that they stay in one shard.

Defined results: turns are ordered by turn (null first), then role, then the digest of the turn; null role or text is
empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty
table has no node; a conversation without turns is a member of the root. A conversation's turns are held together
(24 bytes each), texts of any length are not. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import discard, table, written

#: Bytes of a turn in a path.
STEP = 16
#: Shards at most, and turns of a splitter at most.
MOST_SHARDS, SKELETON_TURNS = 4_000, 64
#: Turns that a shard should have, and paths drawn for each splitter.
SHARD_TURNS, DRAWN = 500_000, 8
#: Bytes of ids that a shard hands on at once for a skeleton node; rows of an Arrow batch.
CHUNK, BATCH = 1 << 16, 20_000
HEADS, SIBLINGS = 9, 5

NODE = "node int, conv_id long, depth int, parent int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, last_bytes long, ends_sha256 string, part long, ids binary"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations_of(conversations: DataFrame) -> DataFrame:
    """base, conv_id and turns (array of digest and bytes of the text, in order) of every conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % SIBLINGS).alias("base")
    # the rows of a base lie together, so that its conversations need no second exchange for the heads
    own = turns.select(base, "*").repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "n"))).alias("turns"))
    return own.select("base", "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (binary, ``STEP`` bytes a turn), bytes (of each turn's text): the first h turns of the base conversation, then the own turns after the first h."""
    own = conversations_of(conversations)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEADS - 1))).over(W.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast("array<struct<digest:string,n:bigint>>")
    turns = F.concat(F.slice(F.coalesce(head, none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    made = own.select("conv_id", turns.alias("turns"))
    return made.select("conv_id", F.unhex(F.concat_ws("", F.col("turns.digest"))).alias("path"), F.col("turns.n").alias("bytes"))


def splitters(convs: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """Ascending (path, conv_id), the least of each shard but the first, from a sample by a hash of the id."""
    size = convs.agg(F.count(F.lit(1)).alias("convs"), F.sum(F.size("bytes") + 1).alias("turns")).first()
    if not size["convs"]:
        return []
    shards = shards or min(MOST_SHARDS, max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["turns"] // SHARD_TURNS))
    share = min(1.0, DRAWN * shards / size["convs"])
    place = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30))
    drawn = convs.filter(place <= int(share * (1 << 30))).select(F.substring("path", 1, STEP * SKELETON_TURNS).alias("path"), "conv_id")
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn.collect())  # about DRAWN * shards short paths
    return sorted({found[len(found) * k // shards] for k in range(1, shards)}) if found else []


def skeleton_of(cuts: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Number of each prefix of a splitter path; the root is 0."""
    nodes = {b"": 0}
    for path, _ in cuts:
        for end in range(STEP, len(path) + 1, STEP):
            nodes.setdefault(path[:end], len(nodes))
    return nodes


class Sheet:
    """Finished rows, column by column; parents are filled in when they are known."""

    def __init__(self):
        self.columns: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}

    def __len__(self):
        return len(self.columns["node"])

    def add(self, **row) -> int:
        for name, column in self.columns.items():
            column.append(row.get(name))
        return len(self) - 1

    def batches(self):
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        made = pa.table({name: pa.array(self.columns[name], kinds[kind]) for name, kind in (c.split() for c in NODE.split(", "))})
        yield from made.to_batches(max_chunksize=BATCH)


class Open:
    """A node on the way to the present path, with what its subtree has given so far."""

    __slots__ = ("node", "low", "n", "children", "leaves", "saved", "last", "sha", "any", "kids", "chunks", "size")

    def __init__(self, node: int | None, last: int):
        self.node, self.last, self.low = node, last, None
        self.n = self.children = self.leaves = self.saved = self.size = 0
        self.sha, self.any = (hashlib.sha256() if node is None else None), False
        self.kids: list[int] = []
        self.chunks: list[bytes] = []


class Scan:
    """One pass over the sorted conversations of a shard."""

    def __init__(self, skeleton: dict[bytes, int], shard: int):
        self.skeleton, self.shard, self.sheet, self.stack, self.path, self.part = skeleton, shard, Sheet(), [Open(0, 0)], b"", 0

    def see(self, conv_id: int, path: bytes, sizes) -> None:
        """The next conversation in order."""
        same = 0
        while same < min(len(path), len(self.path)) and path[same : same + STEP] == self.path[same : same + STEP]:
            same += STEP
        while len(self.stack) - 1 > same // STEP:
            self.close()
        for d in range(len(self.stack), len(path) // STEP + 1):
            on = self.stack[-1].node is not None
            self.stack.append(Open(self.skeleton.get(path[: STEP * d]) if on else None, int(sizes[d - 1])))
        self.path, top = path, self.stack[-1]
        for node in self.stack:
            node.n += 1
            node.low = conv_id if node.low is None or conv_id < node.low else node.low
        self.end(top, conv_id)

    def end(self, node: Open, conv_id: int) -> None:
        """A conversation ends at a node."""
        text = str(conv_id).encode()
        if node.node is None:
            node.sha.update(b"," + text if node.any else text)
        else:
            node.chunks.append(text)
            node.size += len(text)
            if node.size >= CHUNK:
                self.hand_on(node)
        node.any = True

    def hand_on(self, node: Open) -> None:
        """Ids that end at a skeleton node, as far as they are gathered."""
        if node.chunks:
            self.sheet.add(node=node.node, part=self.shard << 32 | self.part, ids=b",".join(node.chunks))
            self.part += 1
            node.chunks, node.size = [], 0

    def close(self) -> None:
        """The deepest open node is done as far as this shard goes."""
        depth, node = len(self.stack) - 1, self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if node.node is not None:
            # what lies in the skeleton below has given its own partial row, so nothing is carried up
            self.hand_on(node)
            self.sheet.add(node=node.node, depth=depth, parent=None if up is None else up.node, conv_id=node.low, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, last_bytes=node.last)
            return
        saved, leaves = node.saved + (node.n - 1) * node.last, node.leaves or 1
        row = self.sheet.add(conv_id=node.low, depth=depth, parent=up.node, n_convs=node.n, n_children=node.children, n_leaves=leaves, saved_tokens=saved, ends_sha256=node.sha.hexdigest())
        for k in node.kids:
            self.sheet.columns["parent_conv_id"][k] = node.low
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.node is None:
            up.kids.append(row)

    def full(self) -> bool:
        """Rows can go: none of them waits for its parent."""
        return len(self.sheet) >= BATCH and not any(n.kids for n in self.stack)

    def batches(self):
        yield from self.sheet.batches()
        self.sheet = Sheet()


def scanned(convs: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """Rows of every shard: finished nodes, partial skeleton nodes (node and depth), ids that end at skeleton nodes (node and ids)."""
    skeleton = skeleton_of(cuts)
    shared = convs.sparkSession.sparkContext.broadcast((cuts, skeleton))  # bounded by MOST_SHARDS and SKELETON_TURNS

    @F.arrow_udf("int")
    def shard_of(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        cuts = shared.value[0]
        return pa.array(np.fromiter((bisect_right(cuts, x) for x in zip(path.to_pylist(), conv_id.to_pylist(), strict=True)), np.int32, len(path)), pa.int32())

    def run(batches):
        skeleton, scan = shared.value[1], None
        for b in batches:
            ids, where, sizes = b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2)
            for k, path in enumerate(b.column(1).to_pylist()):
                if scan is None or scan.shard != where[k]:
                    if scan is not None:
                        yield from last(scan)
                    scan = Scan(skeleton, where[k])
                scan.see(ids[k], path, sizes[k].values)
                if scan.full():
                    yield from scan.batches()
        if scan is not None:
            yield from last(scan)

    def last(scan):
        while scan.stack:
            scan.close()
        return scan.batches()

    dealt = convs.select("conv_id", "path", "bytes", shard_of("path", "conv_id").alias("shard")).repartition(len(cuts) + 1, "shard")
    return dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, NODE)


def end_digests(ids: DataFrame) -> DataFrame:
    """node, ends_sha256 of the chunks of ids of skeleton nodes, read in order."""

    def run(batches):
        node, sha = None, None
        for b in batches:
            done_nodes, done = [], []
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node:
                    if sha is not None:
                        done_nodes.append(node)
                        done.append(sha.hexdigest())
                    node, sha = n, hashlib.sha256(raw)
                else:
                    sha.update(b",")
                    sha.update(raw)
            yield pa.record_batch([pa.array(done_nodes, pa.int32()), pa.array(done, pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([node], pa.int32()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ids.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run, "node int, ends_sha256 string")


def combined(rows: DataFrame, skeleton: dict[bytes, int]) -> DataFrame:
    """The skeleton's nodes from their partial rows: node, then the columns of a finished node (parent_conv_id by node)."""
    spark = rows.sparkSession
    above = {k: [skeleton[p[:end]] for end in range(0, len(p) + 1, STEP)] for p, k in skeleton.items()}
    ways = spark.createDataFrame(list(above.items()), "node int, above array<int>")
    own = rows.filter("node is not null and depth is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("last_bytes").alias("last_bytes"))
    inner = own.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids")).filter("node is not null")
    own = own.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("last_bytes")).withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    sums = own.join(ways, "node").select(F.explode("above").alias("node"), "n_leaves", "saved").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = end_digests(rows.filter("ids is not null").select("node", "part", "ids"))
    low = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = own.drop("n_leaves", "saved", "kids").join(sums, "node").join(digests, "node", "left").join(low, "parent", "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).select("node", *COLUMNS)


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a node of the trie of (conv_id, path, bytes) rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = written(convs)
    cuts = splitters(convs, shards)
    rows = written(scanned(convs, cuts))
    top = written(combined(rows, skeleton_of(cuts)))
    discard(convs)
    parents = F.broadcast(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("_low")))  # at most the skeleton
    local = rows.filter("node is null").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_low"))
    made = local.select(*COLUMNS).unionByName(top.select(*COLUMNS))
    return made.withColumn("depth", F.col("depth").cast("long"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
