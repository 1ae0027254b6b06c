"""Grouping of spelling variants (operator 11) by PartEnum signatures.

A word's letters are a multiset, read as a binary vector: one dimension for each letter and its occurrence number. One
inserted, deleted or replaced letter changes at most two dimensions. The dimensions are dealt to m parts; two vectors of
Hamming distance at most two agree on some m - 2 parts, so each vector signs every choice of m - 2 parts with what it has
there (exact signatures, enumerated). An equi-join of the signatures gives the candidates, which are verified: a pair of
multisets counts at the first of the choices it agrees on, and its differing letters say which single edits can lead
from a word of the one to a word of the other.

Words of one multiset are anagrams and travel as one row. m follows the logarithm of their number, so that candidates grow
about with the vocabulary. Counts are made per text and added up before they are shuffled.

Defined results: a null text has no words; a null doc_id is written as nothing before the colon; repeated rows count as
rows of their own; texts and runs of any length are read whole; no words at all give an empty result. Ties for the
form go to the smallest word in code-point order. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import discard, small_batches, table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_RATE = 97
LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: Words that a Python task counts before it hands them on; characters of a text that are split at once.
HELD, CHARS_AT_ONCE = 200_000, 1_000_000
#: Fewest and most parts of the dimensions.
PARTS = (5, 12)
#: Pairs that a Python task verifies before it adds up what it found.
FOUND = 50_000


def runs_of(text: str):
    """Runs of letters with A-Z in lower case; a long text is not held in pieces at once."""
    low = text.encode("utf-8").lower().decode("utf-8")  # of bytes: A-Z alone
    if len(low) <= CHARS_AT_ONCE:
        yield RUN.findall(low)
        return
    found = RUN.finditer(low)
    while some := [m.group() for m in islice(found, CHARS_AT_ONCE // 8)]:
        yield some


def typed(run: str, start: int) -> str:
    """The run as it counts: one code point is deleted where the hash asks for it. start: crc32 of the id and the colon."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % TYPO_RATE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of at least ``LEAST_CHARS`` code points occurs over all documents."""

    def run(batches):
        held: Counter[str] = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                start, of_text = zlib.crc32(f"{'' if i.as_py() is None else i.as_py()}:".encode()), Counter()
                for some in runs_of(t.as_py() or ""):
                    of_text.update(some)
                for w, n in of_text.items():
                    if len(w) >= LEAST_CHARS and len(w := typed(w, start)) >= LEAST_CHARS:
                        held[w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dimensions(bag: str) -> list[str]:
    """Letters of a sorted word, each with its occurrence number (the first has none)."""
    out, before, k = [], "", 0
    for c in bag:
        k = k + 1 if c == before else 0
        before = c
        out.append(c + str(k) if k else c)
    return out


def vectors(words: DataFrame) -> DataFrame:
    """bag (sorted letters), size and words (each followed by its count, set off by spaces) of every multiset of letters."""

    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.record_batch([pa.array(["".join(sorted(w)) for w in words], pa.string()), pa.array([f"{w} {n}" for w, n in zip(words, b.column(1).to_pylist(), strict=True)], pa.string())], names=["bag", "entry"])

    entries = words.select("word", "n").mapInArrow(run, "bag string, entry string")
    return entries.groupBy("bag").agg(F.concat_ws(" ", F.collect_list("entry")).alias("words"))


def parts_of(many: int) -> int:
    """Parts for so many vectors."""
    return min(PARTS[1], max(PARTS[0], round(many.bit_length() / 2.5)))


def signed(bags: DataFrame, m: int) -> DataFrame:
    """bag, size, words, bits, p0 to p(m-1), choice, signature: a row for each choice of m - 2 parts.

    bits is an exclusive or over the dimensions, so two vectors at distance two or less differ in two bits at most.
    """
    names = [f"p{k}" for k in range(m)]

    def run(batches):
        for b in batches:
            rows, bits = [], []
            for bag in b.column(0).to_pylist():
                parts, mix = [0] * m, 0
                for d in dimensions(bag):
                    h = zlib.crc32(d.encode("utf-8"))
                    mix ^= 1 << h % 63
                    parts[(h >> 8) % m] ^= zlib.crc32(d.encode("utf-8"), 0x5EED)
                rows.append(parts)
                bits.append(mix)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(m)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bits, pa.int64()), *columns], names=["bag", "words", "bits", *names])

    made = small_batches(bags).select("bag", "words").mapInArrow(run, f"bag string, words string, bits long, {', '.join(f'{p} long' for p in names)}")
    signatures = [F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), *[names[k] for k in some]).alias("signature")) for i, some in enumerate(combinations(range(m), m - 2))]
    return made.withColumn("size", F.length("bag")).select("*", F.explode(F.array(*signatures)).alias("_s")).select("bag", "words", "bits", "size", *names, "_s.*")


def candidates(bags: DataFrame, m: int) -> DataFrame:
    """Pairs of multisets that share a signature, each at the first choice of parts it agrees on.

    Both sides are shuffled: Spark sizes them by the file of the multisets, a small part of the rows of all choices.
    """
    left = signed(bags, m)
    right = left.select(*[F.col(c).alias(f"{c}_") for c in left.columns])
    differ = sum((F.when(F.col(f"p{k}") != F.col(f"p{k}_"), 1 << k).otherwise(0) for k in range(m)), F.lit(0))
    choices = [set(some) for some in combinations(range(m), m - 2)]
    first = {mask: next((i for i, some in enumerate(choices) if not any(mask >> k & 1 for k in some)), None) for mask in range(1 << m) if mask.bit_count() <= 2}
    table = F.lit([first.get(mask, -1) for mask in range(1 << m)])
    near = (F.col("signature") == F.col("signature_")) & (F.col("choice") == F.col("choice_")) & (F.col("bag") < F.col("bag_")) & (F.abs(F.col("size") - F.col("size_")) <= 1)
    near &= (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_"))) <= 2) & (F.element_at(table, differ + 1) == F.col("choice"))
    return left.join(right.hint("merge"), near).select("bag", "words", "bag_", "words_")


def one_more(bag: str, other: str) -> tuple[str, str] | None:
    """Letters that only the one and only the other sorted word has, if that is at most one each."""
    more = Counter(bag)
    more.subtract(other)
    up, down = [c for c, k in more.items() if k > 0], [c for c, k in more.items() if k < 0]
    if len(up) > 1 or len(down) > 1 or any(abs(k) > 1 for k in more.values()):
        return None
    return (up[0] if up else ""), (down[0] if down else "")


def edited(word: str, gone: str, come: str) -> set[str]:
    """The word with one of its letters ``gone`` replaced by ``come`` (deleted, if that is empty)."""
    return {word[:i] + come + word[i + 1 :] for i, c in enumerate(word) if c == gone}


def verified(pairs: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: near words of each word, added up in each task as far as they fit."""

    def run(batches):
        held: dict[str, tuple[int, int, str]] = {}

        def see(word: str, n: int, near: str) -> None:
            many, most, best = held.get(word, (0, 0, ""))
            if n > most or n == most and near < best:
                most, best = n, near
            held[word] = many + 1, most, best

        def flush():
            columns = list(zip(*held.values(), strict=True)) or [[], [], []]
            out = pa.record_batch([pa.array(list(held), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["word", "n_near", "best_n", "best"])
            held.clear()
            return out

        for b in batches:
            for bag, words, other, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (letters := one_more(bag, other)) is None:
                    continue
                if not letters[0]:  # the first has a letter less
                    letters, words, others = letters[::-1], others, words
                a, z = words.split(" "), others.split(" ")
                there = dict(zip(z[::2], map(int, z[1::2]), strict=True))
                for w, n in zip(a[::2], map(int, a[1::2]), strict=True):
                    for x in edited(w, *letters):
                        if x in there:
                            see(w, there[x], x)
                            see(x, n, w)
                if len(held) >= FOUND:
                    yield flush()
        yield flush()

    return small_batches(pairs).mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of largest n, the smallest on ties), best_n, of the (word, n) rows that have a near word."""
    bags = written(vectors(words))
    found = verified(candidates(bags, parts_of(bags.count())))
    least = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    made = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("_b")).select("word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b.n")).alias("best_n")))
    discard(bags)
    return made


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form) rows without cycles: pointers double each round until none moves.

    The vocabulary is never broadcast: its packed files are far smaller than its rows.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        discard(at)
        at = moved
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = written(word_counts(docs).filter(F.col("n") >= LEAST_COUNT))
    near = near_words(words)
    strong = F.col("best_n") >= RATIO * F.col("n")
    known = written(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    discard(words, near)
    ends = roots(known.filter("form is not null"))
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents."""
    return group_variants(table(spark, sf_dir, "documents"))
