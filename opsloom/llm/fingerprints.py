"""Document fingerprints by Order MinHash (operator 5, DataFrame functions only).

A text is cut into words (long words into pieces of 8 code points) and read as 2-mers; the occurrences of one k-mer are
numbered, so that repeats count, and all numbered k-mers are hashed. 32 orders of the k-mers are the rotations of the
hash by a 32nd of its range each (circulant permutations). In each order the two smallest k-mers keep their order in
the text and are hashed as a tuple: texts agree in an order only if they share both k-mers and their sequence. The
fingerprint lists the 32 tuples (8 hex digits each); the likeness of two fingerprints is the share of equal tuples.

A k-mer is one long: 34 bits of hash over 30 bits of position (no text has more words), so that one sort of a primitive
array gives order, repeats and minima at once.

Finding the next document needs no global sort: quantiles of doc_id (a bounded list) cut the ids into ranges, a window
runs over each range, and the first row of the range below is added to a range as a ghost row.

Defined results: a null text is read as empty; a text without words has the fingerprint of the empty text ("");
likeness of two empty fingerprints is 1, of an empty and another one 0; equal ids are ordered by a hash of the text;
null ids come last; a single document is its own next one; repeated rows get the same fingerprint. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import table, text_of
from opsloom.llm.rules import let

PIECE = r"[^\x20\x09-\x0D]{1,8}"
ORDERS, RANGE_BITS, POSITION_BITS = 32, 5, 30
POSITION = (1 << POSITION_BITS) - 1
ROWS_A_RANGE, MOST_RANGES = 2000, 65_536


def _hash_of(v: Column) -> Column:
    return F.shiftright(v, POSITION_BITS)


def _packed(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i)


def _range_of(v: Column) -> Column:
    """0 to 31, in the order of the longs."""
    return F.shiftright(v, 64 - RANGE_BITS).cast("int") + ORDERS // 2


def tuples(text: Column) -> Column:
    """Array of 32 longs: in each order the tuple of the two smallest k-mers in text order; empty for a text without words."""

    def of_words(w: Column) -> Column:
        last = F.greatest(F.size(w) - 1, F.lit(1))
        kmers = F.transform(F.sequence(F.lit(1), last), lambda i: _packed(F.xxhash64(F.get(w, i - 1), F.get(w, i)), i.cast("long").bitwiseAND(F.lit(POSITION))))
        return let(F.sort_array(kmers), numbered)

    def numbered(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~_hash_of(F.get(s, i)).eqNullSafe(_hash_of(F.get(s, i - 1))))

        def renumbered(b: Column) -> Column:
            ranks = F.flatten(F.transform(b, lambda at, k: F.sequence(F.lit(0), F.coalesce(F.get(b, k + 1), n) - at - 1)))
            again = F.zip_with(s, ranks, lambda v, r: F.when(r == 0, v).otherwise(_packed(F.xxhash64(_hash_of(v), r), v.bitwiseAND(F.lit(POSITION)))))
            return F.when(F.size(b) == n, s).otherwise(F.sort_array(again))

        return let(let(starts, renumbered), minima)

    def minima(s: Column) -> Column:
        two = F.filter(s, lambda v, i: ~_range_of(v).eqNullSafe(_range_of(F.get(s, i - 2))))

        def joined(t: Column) -> Column:
            # the smallest in an order is the first of the first range from there on that is not empty, then comes its successor
            def tuple_at(v: Column, i: Column) -> Column:
                mate = F.coalesce(F.get(t, i + 1), F.get(t, F.lit(0)))
                swap = mate.bitwiseAND(F.lit(POSITION)) < v.bitwiseAND(F.lit(POSITION))
                a, b = F.when(swap, _hash_of(mate)).otherwise(_hash_of(v)), F.when(swap, _hash_of(v)).otherwise(_hash_of(mate))
                return F.xxhash64(a, b).bitwiseAND(F.lit((1 << 32) - 1))

            def orders(v: Column, i: Column) -> Column:
                before = F.coalesce(_range_of(F.get(t, i - 1)), F.lit(-1))
                return F.array_repeat(tuple_at(v, i), _range_of(v) - before)

            around = F.array_repeat(tuple_at(F.get(t, F.lit(0)), F.lit(0)), ORDERS - 1 - _range_of(F.element_at(t, -1)))
            return F.concat(F.flatten(F.transform(t, orders)), around)

        return let(two, joined)

    words = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) > 0, of_words(w)).otherwise(F.array().cast("array<bigint>")))


def spelled(t: Column) -> Column:
    """The fingerprint as text: 8 hex digits an order."""
    return F.array_join(F.transform(t, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the orders in which both have the same tuple; 1 for two empty ones, 0 for an empty and another one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(ORDERS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same)


def _range_index(cuts: list[int], value: Column) -> Column:
    """Number of cuts below the value, searched in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))

    def constant(values: list[int]) -> Column:
        # one literal that is folded once, whatever the number of cuts
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    block = F.size(F.filter(constant([cuts[min(i + step, len(cuts)) - 1] for i in range(0, len(cuts), step)]), lambda c: c < value))
    inner = F.size(F.filter(F.slice(constant(cuts), block * step + 1, F.lit(step)), lambda c: c < value))
    return F.least(block * step, F.lit(len(cuts))) + inner


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own (tuples), next_text, next_own: the next document by descending doc_id, cyclic."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    parts = min(MOST_RANGES, math.ceil(max(1, n) / ROWS_A_RANGE))
    cuts = []
    if parts > 1 and known:
        quantiles = [k / parts for k in range(1, parts)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", quantiles, max(10_000, 4 * parts))).first()[0]))
    text = text_of()
    place = F.coalesce(_range_index(cuts, F.col("doc_id").cast("long")), F.lit(-1))
    rows = docs.select("doc_id", text.alias("text"), place.alias("part"), F.xxhash64(text).alias("tie"))
    # the first row of each range: the largest id, then the largest hash (a bounded table of narrow rows)
    order = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "tie")
    heads = [(r["part"], r["h"]["doc_id"], r["h"]["tie"]) for r in rows.groupBy("part").agg(F.max(order).alias("h")).collect()]
    heads.sort(reverse=True)
    spark = docs.sparkSession
    above = {heads[k][0]: heads[k - 1][0] for k in range(len(heads))}  # of the first range: the last one
    ghosts = spark.createDataFrame([(p, d, t, above[p]) for p, d, t in heads], f"g_part int, g_id {rows.schema['doc_id'].dataType.simpleString()}, g_tie long, g_above int")
    met = rows.join(F.broadcast(ghosts), (F.col("part") == F.col("g_part")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    ghost_rows = met.dropDuplicates(["g_part"]).select("doc_id", "text", F.col("g_above").alias("part"), "tie", F.lit(1).alias("ghost"))
    all_rows = rows.withColumn("ghost", F.lit(0)).unionByName(ghost_rows).withColumn("own", tuples(F.col("text")))
    w = W.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    led = all_rows.withColumns({"next_text": F.lead("text").over(w), "next_own": F.lead("own").over(w)})
    return led.filter("ghost = 0").select("doc_id", "text", "own", "next_text", "next_own")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of all documents."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", tuples(F.col("edited")).alias("new"))
    return rows.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
