"""N-gram Jaccard join (operator 2): exact near-duplicate components over distinct 5-word shingles.

The document by n-gram incidence matrix is multiplied with its transpose in column blocks. Partial overlap counts are
added up by pair, and rows and pairs are given up as soon as a bound derived from the set sizes shows that they
cannot reach the threshold:

1. Texts with one shingle set are one row of the matrix (identified by a 128-bit digest), so copies are never paired.
2. Column blocks (ranges of n-gram hashes, packed arrays) count in how many sets each n-gram occurs. N-grams of one
   set cannot add to any overlap and stay behind; only the rest travels on. A set of size n keeps its place only if at
   least 0.75 n of its n-grams are left, since any partner must share that many. Entries of n-grams that hold more
   than 1/65,536 of the matrix (found in the first pass, a bounded list) need no count and are dealt by set
   instead, so that no block has to hold all sets with a very common passage.
3. N-grams are ordered by (occurrence, hash). Two linked sets share one among the first n - ceil(0.75 n) + 1 of both,
   so the product is formed on those columns.
4. First every column's rows are multiplied with one pivot row only (the one with the fewest n-grams of its own),
   which is linear. The links found are contracted to components; then rows of different components are multiplied.
   A block (a shuffle partition of columns) adds up its overlap counts by pair, the blocks' counts are added, and a
   pair goes on only if its count plus what both rows have left beyond the last common column can reach the overlap
   that the two sizes ask for. Nothing is capped or sampled.
5. What is left is checked with the full overlap count of the two rows.

A column is known by its block and 40 bits of hash in it (a block has about a million entries), and a shingle by 64 bits. Links are
exact but for what different n-grams with equal bits add to an overlap, which can matter at the very threshold only. Packed batches are named by
a digest of their sets, so that a task that is run again gives the same names; the docs have to come from files (or
another source that keeps its order when read again).

Joins are plain equi-joins, which adaptive execution can split where a key is hot; groups are summed map-side first.

Defined results: a text without words (or null) has size 0 and is a component of its own; fewer than five words make one
shingle; repeated rows share a set; a component's id is the smallest doc_id in it (null ids are passed over, a
component with none has a null id). Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import discard, small_batches, table, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Entries of the matrix in a column block, and in a packed batch of a map task.
BLOCK_ENTRIES, BATCH_ENTRIES, BATCH_SETS = 1_000_000, 500_000, 65_535
LEAST_BLOCKS = 48
#: N-grams with more than 1/HOT_MOST of all entries are common; a batch reports those that DENSE of its sets hold.
HOT_MOST, DENSE = 65_536, 8
#: Kinds of payloads, and the rank of common n-grams in the order (others have eight ranks a doubling).
ENTRIES, HEADS, COMMON = range(3)
COMMON_RANK = 255
LOW32, LOW40 = np.uint64((1 << 32) - 1), np.uint64((1 << 40) - 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand, emptied when full."""

    def __missing__(self, word):
        if len(self) >= 30_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(29)
    out *= _ODD[5]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_id(sorted_hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16).digest()


def _dense(sets: dict[bytes, np.ndarray]) -> bytes | None:
    """N-grams that occur in many of some sets, with their counts."""
    if not sets:
        return None
    grams, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    many = counts >= DENSE
    return grams[many].tobytes() + counts[many].astype(np.uint64).tobytes() if many.any() else None


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (null without words), n: the size of each document's shingle set.

    ``dense`` (null in most rows) counts the common n-grams of every eighth set in a batch of a task.
    """
    kept = small_batches(docs).select("doc_id", "text")

    def run(batches):
        hashes, known, held, last = WordHashes(), {}, 0, None

        def with_dense(rows, dense):
            return pa.record_batch([*rows, pa.array([None] * (len(rows[0]) - 1) + [dense], pa.binary())], names=["doc_id", "set_id", "n", "dense"])

        for b in batches:
            if not b.num_rows:
                continue
            if last:
                yield with_dense(last, _dense(known) if held >= BATCH_ENTRIES else None)
                if held >= BATCH_ENTRIES:
                    known, held = {}, 0
            sets = [shingles(t.as_py(), hashes) for t in b.column(1)]
            ids = [set_id(s) if len(s) else None for s in sets]
            for i, s in zip(ids, sets, strict=True):
                if i and i[0] % 8 == 0 and i not in known:
                    known[i] = s
                    held += len(s)
            last = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
        if last:
            yield with_dense(last, _dense(known))

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, set_id binary, n long, dense binary")


def common_grams(members: DataFrame, entries: int) -> np.ndarray:
    """Sorted hashes of the n-grams that hold more than 1/HOT_MOST of the matrix: at most HOT_MOST of them."""

    def run(batches):
        for b in batches:
            for x in b.column(0):
                grams, counts = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                yield pa.record_batch([pa.array(grams), pa.array(counts)], names=["gram", "many"])

    dense = members.filter("dense is not null").select("dense").mapInArrow(run, "gram long, many long")
    found = dense.groupBy("gram").agg(F.sum("many").alias("many")).filter(F.col("many") * 8 > max(entries / HOT_MOST, BLOCK_ENTRIES / 16))
    return np.sort(np.array([r["gram"] for r in found.select("gram").collect()], np.int64).view(np.uint64))


# --- packed rows of the matrix -------------------------------------------------------------------------------------
#
# Map side, one payload a (batch, block): batch name, owners as steps, 40-bit hashes. From a block, one payload a part:
# segments of batches with owners, columns and ranks. Beside them a batch's sets and its common entries go to its part
# under the key ``blocks + part``.


def _split40(h: np.ndarray) -> bytes:
    return (h & LOW32).astype(np.uint32).tobytes() + ((h >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _joined40(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32, n, at).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, at + 4 * n).astype(np.uint64) << np.uint64(32))


def _pack_entries(name: int, owner: np.ndarray, h: np.ndarray) -> bytes:
    """One batch's entries in one block, ordered by owner."""
    steps = np.diff(owner, prepend=0)
    width = 1 if steps.max() < 256 else 2
    return np.array([name, len(h), width], np.int64).tobytes() + steps.astype(f"u{width}").tobytes() + _split40(h)


def _unpack_entries(raw: bytes):
    name, n, width = np.frombuffer(raw, np.int64, 3)
    owner = np.cumsum(np.frombuffer(raw, f"u{width}", n, 24), dtype=np.int64)
    return name, owner.astype(np.uint16), _joined40(raw, n, 24 + width * n)


def _rows(found, name: str):
    found = list(found)
    return pa.record_batch([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=[name, "payload"])


def _ranges(keys: np.ndarray):
    """(key, start, end) of the runs of an ordered array."""
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield from zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def _block_of(entries: np.ndarray, blocks: int) -> np.ndarray:
    return (entries >> np.uint64(40)) % np.uint64(blocks)


def column_blocks(docs: DataFrame, blocks: int, common: np.ndarray) -> DataFrame:
    """(block, payload): the incidence matrix in packed column blocks; a set once in a batch of a task."""

    def flush(ids, sets):
        name = int.from_bytes(hashlib.blake2b(b"".join(ids), digest_size=8).digest(), "little", signed=True)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
        entries = np.concatenate(sets)
        part = blocks + name % blocks
        out = [(part, np.array([HEADS, name, len(sets)], np.int64).tobytes() + b"".join(ids) + sizes.tobytes())]
        if len(common):
            hot = common[np.searchsorted(common, entries).clip(max=len(common) - 1)] == entries
            if hot.any():
                columns = (_block_of(entries[hot], blocks) << np.uint64(40)) | (entries[hot] & LOW40)
                out.append((part, np.array([COMMON, name, len(columns)], np.int64).tobytes() + owner[hot].astype(np.uint16).tobytes() + columns.tobytes()))
                owner, entries = owner[~hot], entries[~hot]
        block = _block_of(entries, blocks).astype(np.int32)
        order = np.argsort(block, kind="stable")
        block, owner, entries = block[order], owner[order], entries[order]
        return _rows(out + [(b, _pack_entries(name, owner[s:e], entries[s:e])) for b, s, e in _ranges(block)], "block")

    def run(batches):
        hashes, ids, sets, held = WordHashes(), [], [], 0
        known: set[bytes] = set()
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), hashes)
                if len(s) and (i := set_id(s)) not in known:
                    known.add(i)
                    ids.append(i)
                    sets.append(s)
                    held += len(s)
                    if held >= BATCH_ENTRIES or len(sets) == BATCH_SETS:
                        yield flush(ids, sets)
                        ids, sets, held = [], [], 0
                        known.clear()
        if sets:
            yield flush(ids, sets)

    return small_batches(docs).select("text").mapInArrow(run, "block int, payload binary")


def shared_columns(packed: DataFrame, blocks: int) -> DataFrame:
    """(part, payload): entries whose n-gram came from two sets or more, with a rank of its occurrences, dealt by batch.

    Copies of a set in different batches count too, which changes the order of the columns alike for all sets.
    """

    def run(key, t):
        block = key[0].as_py()
        if block >= blocks:  # sets and common entries of a batch, on their way to its part
            return pa.table([pa.array([block - blocks] * t.num_rows, pa.int32()), t.column("payload")], names=["part", "payload"])
        found = [_unpack_entries(p.as_py()) for p in t.column("payload")]
        owner, h = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        source = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
        names = np.array([x[0] for x in found], np.int64)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        occurs = np.diff(np.r_[starts, len(h)])
        times = np.empty(len(h), np.int64)
        times[order] = np.repeat(occurs, occurs)
        keep = np.flatnonzero(times > 1)
        part = names[source[keep]] % blocks
        keep = keep[np.argsort(part, kind="stable")]
        rank = np.minimum(8 * np.log2(times[keep]), COMMON_RANK - 1).astype(np.uint8)

        def packed_part(s, e):
            here = keep[s:e]
            segments = [(names[x], b - a) for x, a, b in _ranges(source[here])]
            head = np.array([ENTRIES, block, len(segments), e - s], np.int64).tobytes() + np.array(segments, np.int64).T.tobytes()
            return head + owner[here].tobytes() + rank[s:e].tobytes() + _split40(h[here])

        return pa.Table.from_batches([_rows([(p, packed_part(s, e)) for p, s, e in _ranges(np.sort(part))], "part")])

    return packed.groupBy("block").applyInArrow(run, "part int, payload binary")


def surviving_sets(shared: DataFrame) -> DataFrame:
    """set_id, n, own (n-grams of this set alone), grams (the others in the common order) of sets that can be linked."""

    def run(key, t):
        ids, sizes, first, later, total = [], [], {}, [], 0
        for p in t.column("payload"):
            raw = p.as_py()
            kind, name, n = np.frombuffer(raw, np.int64, 3).tolist()
            if kind != HEADS:
                later.append(raw)
            elif name not in first:
                first[name] = total
                total += n
                ids.append(raw[24 : 24 + 16 * n])
                sizes.append(np.frombuffer(raw, np.int64, n, 24 + 16 * n))
        owner, rank, column = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)]
        for raw in later:
            if np.frombuffer(raw, np.int64, 1)[0] == COMMON:
                _, name, n = np.frombuffer(raw, np.int64, 3).tolist()
                owner.append(np.frombuffer(raw, np.uint16, n, 24) + np.int64(first[name]))
                rank.append(np.full(n, COMMON_RANK, np.uint8))
                column.append(np.frombuffer(raw[24 + 2 * n :], np.uint64))
                continue
            _, block, segments, n = np.frombuffer(raw, np.int64, 4).tolist()
            names, counts = np.frombuffer(raw, np.int64, 2 * segments, 32).reshape(2, -1)
            at = 32 + 16 * segments
            owner.append(np.frombuffer(raw, np.uint16, n, at) + np.repeat([first[x] for x in names.tolist()], counts))
            rank.append(np.frombuffer(raw, np.uint8, n, at + 2 * n))
            column.append(_joined40(raw, n, at + 3 * n) | (np.uint64(block) << np.uint64(40)))
        ids, sizes = b"".join(ids), np.concatenate([*sizes, np.zeros(0, np.int64)])
        owner, rank, column = (np.concatenate(x) for x in (owner, rank, column))
        order = np.lexsort((column, rank, owner))
        owner, column = owner[order], column[order]
        if len(owner):  # a batch that came twice gives its entries twice
            fresh = np.r_[True, (owner[1:] != owner[:-1]) | (column[1:] != column[:-1])]
            owner, column = owner[fresh], column[fresh]
        counts = np.bincount(owner, minlength=len(sizes))
        starts = np.r_[0, np.cumsum(counts)]
        keep = np.flatnonzero(DENOMINATOR * counts >= NUMERATOR * sizes)
        lists = pa.array([column[starts[i] : starts[i + 1]].view(np.int64) for i in keep], pa.list_(pa.int64()))
        return pa.table([pa.array([ids[16 * i : 16 * i + 16] for i in keep], pa.binary()), pa.array(sizes[keep], pa.int64()), pa.array((sizes - counts)[keep], pa.int64()), lists], names=["set_id", "n", "own", "grams"])

    return shared.groupBy("part").applyInArrow(run, "set_id binary, n long, own long, grams array<long>").dropDuplicates(["set_id"])


# --- product, confirmation, components -----------------------------------------------------------------------------


def prefixes(sets: DataFrame) -> DataFrame:
    """(gram, set_id, n, own, at): the columns on which a link must show, with the place in the order."""
    length = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1 - F.col("own")
    cut = F.slice("grams", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    return sets.select("set_id", "n", "own", F.posexplode(cut).alias("k", "gram")).select("gram", "set_id", "n", "own", (F.col("own") + F.col("k")).alias("at"))


def counted(products: DataFrame) -> DataFrame:
    """Pairs (a, b) whose overlap can still reach what their sizes ask for, from one row (a, n_a, at_a, b, n_b, at_b) a
    common column.

    The counts of a block of columns are added up where they arise and then by pair. Columns of a pair that are not
    among the products come after the last of those that are.
    """
    sums = products.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    most = F.col("common") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    return sums.filter((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _sizes_fit(n, m):
    return (DENOMINATOR * n >= NUMERATOR * m) & (DENOMINATOR * m >= NUMERATOR * n)


def _positions_fit(n, at, m, other):
    """Overlap still possible from the first common column on, against the overlap that the sizes ask for."""
    return (NUMERATOR + DENOMINATOR) * F.least(n - at, m - other) >= NUMERATOR * (n + m)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the overlap of the whole rows; ``linked`` says whether it reaches the threshold."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    both = pairs.join(left, "a").join(right, "b")
    out = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).cast("long").alias("common"))
    return out.withColumn("linked", DENOMINATOR * F.col("common") >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("common")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge list (a, b): label is the smallest node reachable.

    Labels fall to the smallest among neighbours and then to the label of the label, so stars and chains shrink fast.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    first = F.least("node", "m")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", first.alias("label"), F.lit(True).alias("changed")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("hop"), F.col("label").alias("next"))
        new = written(moved.join(jump, "hop").select("node", F.least("hop", "next").alias("label"), (F.col("old") != F.least("hop", "next")).alias("changed")))
        discard(labels)
        labels = new
        if not new.filter("changed").limit(1).count():
            discard(both)
            return labels


def cross_rows(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of mixed columns with each other component that some member of it could reach, and the rows to meet there.

    A component in a column is summed up by its smallest and largest set and its longest reach (entries from the column
    on); a row goes on to a component only if those bounds leave a link possible.
    """
    reach = F.col("n") - F.col("at")
    classes = labelled.groupBy("gram", "label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(reach).alias("reach"))
    mixed = classes.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("gram")
    classes = written(classes.join(mixed, "gram"))
    one, two = (classes.select("gram" if k == "a" else F.col("gram").alias("g2"), F.col("label").alias(f"l{k}"), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"), F.col("reach").alias(f"reach_{k}")) for k in "ab")

    def possible(low_a, high_a, reach_a):
        sizes = (DENOMINATOR * high_a >= NUMERATOR * F.col("low_b")) & (DENOMINATOR * F.col("high_b") >= NUMERATOR * low_a)
        return sizes & ((NUMERATOR + DENOMINATOR) * F.least(reach_a, F.col("reach_b")) >= NUMERATOR * (low_a + F.col("low_b")))

    meets = one.join(two, (F.col("gram") == F.col("g2")) & (F.col("la") < F.col("lb")) & possible(F.col("low_a"), F.col("high_a"), F.col("reach_a"))).drop("g2")
    left = labelled.select(F.col("gram").alias("g1"), F.col("label").alias("l1"), F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    half = meets.join(left, (F.col("gram") == F.col("g1")) & (F.col("la") == F.col("l1")) & possible(F.col("n_a"), F.col("n_a"), F.col("n_a") - F.col("at_a")))
    right = labelled.select(F.col("gram").alias("g2"), F.col("label").alias("l2"), F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    return half.select("gram", "lb", "a", "n_a", "at_a"), right


def link_components(sets: DataFrame) -> DataFrame:
    """(node, label) of the sets that have a link."""
    columns = written(prefixes(sets))
    pivot = F.min(F.struct((F.col("own") / F.col("n")).alias("o"), (-F.col("n")).alias("m"), "set_id", "at"))
    per = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), pivot.alias("p")).filter("many > 1")
    per = written(per.select("gram", F.col("p.set_id").alias("b"), (-F.col("p.m")).alias("n_b"), F.col("p.at").alias("at_b")))
    fits = _sizes_fit(F.col("n_a"), F.col("n_b")) & _positions_fit(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))
    rows = columns.select("gram", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    stars = counted(rows.join(per, "gram").filter("a <> b").filter(fits))
    tried = written(confirmed(stars, sets).select("a", "b", "linked"))
    labels = components(tried.filter("linked"))
    # What is left: columns that still hold more than one component.
    labelled = columns.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    labelled = written(labelled)
    discard(columns, per)
    half, right = cross_rows(labelled)
    cross = counted(half.join(right, (F.col("gram") == F.col("g2")) & (F.col("lb") == F.col("l2")) & fits))
    done = tried.filter(~F.col("linked")).select("a", "b")
    done = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = written(confirmed(cross.join(done, ["a", "b"], "left_anti"), sets).filter("linked").select("a", "b"))
    discard(labelled)
    if not found.limit(1).count():
        return labels
    out = components(tried.filter("linked").select("a", "b").unionByName(found))
    discard(tried, found, labels)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id of every document."""
    members = written(shingle_sets(docs))
    entries = members.groupBy("set_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(entries / BLOCK_ENTRIES))
    sets = written(surviving_sets(shared_columns(column_blocks(docs, blocks, common_grams(members, entries)), blocks)))
    labels = link_components(sets)
    smallest = members.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = smallest.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    classes = written(classes)
    heads = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = written(classes.join(heads, "label").select("set_id", "component_id"))
    discard(sets, labels, classes)
    out = members.join(by_set, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays; documents without words stay.

    Of rows that repeat both doc_id and text one stays. Ids of the documents that go are joined (anti) on doc_id; a
    row with a null doc_id is never removed.
    """
    found = written(near_duplicates(docs).select("doc_id", "component_id"))
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    repeats = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    out = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if repeats:
        ids = out.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
        out = ids.unionByName(out.filter("doc_id is null"))
    return out


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
