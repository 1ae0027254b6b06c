"""Quality rules: a threshold table compiled into one Spark projection (operator 4, DataFrame functions only).

``metrics`` derives length, symbol, stop-word and line measures of a text from built-in functions; ``RULES`` names the
bounds; ``verdict`` compiles them into one Column. No shuffle, no user function: one scan, one projection.

Defined results: a null text is read as empty (all counts 0, base_failed true, kept false); ratios with a zero denominator are
0; very long texts are read whole; repeated rows give repeated results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import WORD_RUN, table, text_of, words_of

#: Common words of the four languages that the stop-word rule knows.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this are at an from or "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch er "
    "de la le et les des en un une du que est pour dans qui au il sur par ce "
    "el los las y del se una por con para al lo como su es"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= metric <= high``; the rule speaks only when ``min_words`` words are there."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0

    def passed(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (F.col(self.metric) >= self.low)
        if self.high is not None:
            ok = ok & (F.col(self.metric) <= self.high)
        return (F.col("n_words") < self.min_words) | ok


#: The threshold table.
RULES = (
    Rule("mean word length", "mean_word_chars", low=1.0, high=18.0),
    Rule("symbols a word", "symbols_per_word", high=0.25),
    Rule("marks a word", "marks_per_word", high=0.4, min_words=20),
    Rule("stop words", "stop_word_share", low=0.02, min_words=50),
    Rule("repeated lines", "dup_line_share", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more, given the array of words.

    A window is known by its 64-bit hash. Only where a hash occurs twice are (hash, position) pairs sorted and the
    covered stretch of each repeated window added up.
    """
    count = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            at = F.filter(F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
            return let(F.array_sort(at), lambda s: F.aggregate(F.transform(s, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return let(pairs, repeated)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(count <= WINDOW, F.lit(0)).otherwise(found)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element array is mapped."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of the text."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RUN))
    stop = list(STOP_WORDS)
    one = docs.select(
        "doc_id",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("kinds"))).alias("lines"),
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeated"), F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).alias("stop"))).alias("w"),
    )
    n = F.col("w.n").cast("long")

    def per(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return one.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.kinds")).cast("long").alias("n_dup_lines"),
        F.col("w.repeated").cast("long").alias("n_repeat_words"),
        per(F.col("word_chars"), n).alias("mean_word_chars"),
        per(F.col("n_symbols"), n).alias("symbols_per_word"),
        per(F.col("n_marks"), n).alias("marks_per_word"),
        per(F.col("w.stop"), n).alias("stop_word_share"),
        per(F.col("lines.all") - F.col("lines.kinds"), F.col("lines.all")).alias("dup_line_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures, base_failed, kept and the names of the failed rules."""
    failed = F.filter(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    out = metrics(docs).withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
