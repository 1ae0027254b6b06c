"""Language identification by word-first backoff (operator 9).

A word that the model knows is scored by its per-language log frequency. An unseen word falls back to its longest
character n-grams that the model knows, then to shorter ones, at a fixed cost a step. A document's language is the
one with the largest sum; the score is the winner's share when the mean log likelihood a word is sharpened by a
bounded number of words.

The model is counted by Spark over whole texts of a bounded sample of labelled rows: each language has a quota of
``max_rows`` shared by the languages (one row at least), drawn by a hash of doc_id and text; copies in the sample count once.
Every word and n-gram of the sample, of every language, is an entry. A table is three flat arrays (sorted hashes, languages, log
frequencies), about 20 bytes an entry, so the model is bounded by the sample and is broadcast whole.

Defined results: a null text, or one without a letter (``\\p{L}``), gives ``und`` and score 0; with no labelled rows at all
everything is ``und``; repeated rows get the same result; very long texts are read whole. Only ``doc_id``, ``text``
and, for learning, ``lang`` are read; the prediction sees the text alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import discard, fold, small_batches, table, written

UNKNOWN = "und"
#: Numbers of ``CACHE_FLOATS`` scores at most are kept by a Python worker, a row a word.
CACHE_FLOATS = 4_000_000
#: Documents whose new words are scored together.
DOCS_AT_ONCE = 64
LONGEST = 5
STEP_COST = 0.4
#: Seed of Spark's xxhash64.
SEED = 42


#: Word characters without the mark and the digits, and those of them that are numbers all the same.
LETTERS = re.compile(r"[^\W\d_]+")
NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the text in lower case."""
    low = (text or "").lower()
    if not low.isascii() and (odd := NUMBERS.intersection(low)):
        low = low.translate(dict.fromkeys(map(ord, odd), " "))
    return LETTERS.findall(low)


def hashes(items: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for strings."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8"), SEED) for x in items), np.uint64, len(items)).view(np.int64)


class Table:
    """Per-language log frequencies of items: what an unseen item has, and what an item adds to that where it was seen."""

    def __init__(self, items: np.ndarray, langs: np.ndarray, counts: np.ndarray, many: int, smooth: float = 0.5):
        """A row for each (hash of item, number of language, count)."""
        order = np.lexsort((langs, items))
        items, self.langs, counts = items[order], langs[order].astype(np.int32), counts[order]
        self.keys, first = np.unique(items, return_index=True)
        self.first = np.append(first, len(items)).astype(np.int64)
        totals = np.bincount(self.langs, weights=counts, minlength=many)
        self.unseen = np.log(smooth / (totals + smooth * max(1, len(self.keys))))
        self.more = np.log((counts + smooth) / smooth).astype(np.float64)

    def find(self, items: np.ndarray) -> np.ndarray:
        """Place of each item; -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return np.where(self.keys[at] == items, at, -1)

    def add(self, scores: np.ndarray, rows: np.ndarray, places: np.ndarray, share: np.ndarray) -> None:
        """Add what the known items at ``places`` have beyond unseen ones to rows of scores, times a share."""
        sizes = self.first[places + 1] - self.first[places]
        entry = np.repeat(self.first[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        np.add.at(scores, (np.repeat(rows, sizes), self.langs[entry]), self.more[entry] * np.repeat(share, sizes))


class Scores:
    """Scored words of a worker: a matrix of a bounded number of rows, filled on demand and emptied when full."""

    def __init__(self, langs: int):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((max(1, CACHE_FLOATS // max(1, langs)), langs))


class Model:
    """Tables of words and of character n-grams by length (with ``^`` and ``$`` at word ends)."""

    def __init__(self, langs: list[str], words: Table, grams: list[Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def score(self, words: list[str], out: np.ndarray) -> None:
        """Log scores of words in each language, into rows of ``out``."""
        places = self.words.find(hashes(words))
        known = np.flatnonzero(places >= 0)
        out[known] = self.words.unseen
        self.words.add(out, known, places[known], np.ones(len(known)))
        rest = np.flatnonzero(places < 0)
        out[rest] = 0.0
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                return
            padded = [f"^{words[k]}$" for k in rest.tolist()]
            sizes = np.array([max(0, len(p) - n + 1) for p in padded])
            whose = np.repeat(np.arange(len(rest)), sizes)
            places = self.grams[n - 1].find(hashes([p[i : i + n] for p in padded for i in range(len(p) - n + 1)]))
            whose, places = whose[places >= 0], places[places >= 0]
            many = np.bincount(whose, minlength=len(rest))
            out[rest[many > 0]] = self.grams[n - 1].unseen - STEP_COST * (LONGEST - n + 1)
            self.grams[n - 1].add(out, rest[whose], places, 1 / many[whose])
            rest = rest[many == 0]

    def word(self, w: str) -> list[float]:
        """Log score of one word in each language."""
        out = np.zeros((1, len(self.langs)))
        self.score([w], out)
        return out[0].tolist()

    def sums(self, counts: Counter, cache: Scores) -> np.ndarray:
        """Sum of the scores of counted words."""
        total, words, size = np.zeros(len(self.langs)), list(counts), len(cache.rows)
        for k in range(0, len(words), size):
            some = words[k : k + size]
            self.warm(some, cache)
            total += np.fromiter((counts[w] for w in some), np.float64, len(some)) @ cache.rows[[cache.at[w] for w in some]]
        return total

    def predict(self, texts: list[str | None], cache: Scores) -> Iterator[tuple[str, float]]:
        """(language, score) of each text."""
        for k in range(0, len(texts), DOCS_AT_ONCE):
            found = [Counter(words_of(t)) for t in texts[k : k + DOCS_AT_ONCE]]
            if self.langs:
                union = set().union(*found)
                if len(union) <= len(cache.rows):
                    self.warm(union, cache)
            for counts in found:
                if not counts or not self.langs:
                    yield UNKNOWN, 0.0
                    continue
                n = counts.total()
                mean = self.sums(counts, cache) / n
                odds = np.exp((mean - mean.max()) * min(n, 20))
                best = int(np.argmax(odds))
                yield self.langs[best], float(odds[best] / odds.sum())

    def warm(self, words, cache: Scores) -> None:
        """Score the new ones of some words at once."""
        new = [w for w in words if w not in cache.at]
        if len(cache.at) + len(new) > len(cache.rows):
            cache.at.clear()
            new = list(words)
        if new:
            start = len(cache.at)
            self.score(new, cache.rows[start : start + len(new)])
            cache.at.update(zip(new, range(start, start + len(new)), strict=True))


def sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """(lang, text): each language up to about its quota, its row of lowest place always, copies once."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low")))
    quota = max(1, max_rows // max(1, sizes.count()))
    share = sizes.select("lang", "low", F.least(F.lit(1.0), F.lit(quota) / F.col("n")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").filter((place < F.col("share")) | (place <= F.col("low")))  # a row a language
    return drawn.select("lang", "text").dropDuplicates()


def counted(entries: DataFrame, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of the rows (item, lang, c), which are bounded by the sample."""
    got = entries.select("item", "lang", "c").toArrow()
    return got["item"].to_numpy(), pc.index_in(got["lang"].combine_chunks(), langs).to_numpy(zero_copy_only=False), got["c"].to_numpy()


def train(labelled: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on (doc_id, text, lang) rows; rows without a language or text are not used."""
    rows = written(sample(labelled, max_rows))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    names, many = pa.array(langs, pa.string()), len(langs)
    words = written(rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c")))
    padded = F.concat(F.lit("^"), "w", F.lit("$"))

    def of_length(n: int):
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, some).otherwise(F.array().cast("array<string>"))

    def table_of(n: int) -> Table:
        grams = words.select("lang", "c", F.explode(of_length(n)).alias("g")).groupBy("lang", F.xxhash64("g").alias("item")).agg(F.sum("c").alias("c"))
        return Table(*counted(grams, names), many)

    model = Model(langs, Table(*counted(words.select(F.xxhash64("w").alias("item"), "lang", "c"), names), many), [table_of(n) for n in range(1, LONGEST + 1)])
    discard(rows, words)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs named doc_id and text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of train()

    def run(batches):
        model = shared.value
        cache = Scores(len(model.langs))
        for b in batches:
            found = list(model.predict(b.column(1).to_pylist(), cache))
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out():
    """The fold that learning never sees: crc32 of the id modulo 3 is 1 (false for a null id)."""
    return F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))


def reject_unknown(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is not known, or whose best language has under half the odds, go.

    Only texts go to Python and only verdicts come back; the rows themselves stay where they are, and nothing is
    shuffled.
    """
    model = train(docs.filter(~held_out()))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        cache = Scores(len(model.langs))
        for texts in batches:
            found = model.predict(texts.to_pylist(), cache)
            yield pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_())

    return small_batches(docs).filter(known(F.col("text")))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
