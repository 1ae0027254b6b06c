"""Quality classifier by compression (operator 10).

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text that resembles the bad
ones is compressed better with the bad dictionary, so the difference of the two compressed sizes, normalised by the
text's own size, tells the classes apart; a logistic curve of that difference alone, fitted on other labelled rows,
makes it a probability of label 1. Texts are compressed whole, in pieces of ``PIECE`` bytes, so that the dictionaries
count as much at the end of a long text as at its start.

The dictionaries and the curve are fitted on bounded samples of labelled rows (``per_class`` rows a class for the
dictionaries and as many for the curve, chosen by a hash of the id, texts of at most ``max_chars``): the sample of labels is
drawn first, so that documents are scanned once and not shuffled. Scoring is one more scan, in Arrow batches.

Defined results: a null text is scored as an empty one; with labels of one class only, or none, the score is the share of
label 1 among the labels (0.5 with none); repeated rows get the same score; copies among the sampled
texts and repeated labels count once. Only ``doc_id`` and ``text`` of documents and ``doc_id`` and ``quality`` of labels are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import discard, fold, small_batches, table, written

LEVEL = 3
THRESHOLD = 0.7
DICT_BYTES = 96 * 1024
#: Texts are cut into pieces of so many bytes, for compression and for the dictionary builder (which sees all of them).
PIECE = 600


class Model:
    """Dictionaries of the two classes and the weights of the curve."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float], prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def compressors(self):
        def one(raw):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

        return one(self.good), one(self.bad)


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8")
    return [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]


def difference(text: str | None, good, bad) -> float:
    """Bytes that the good dictionary saves against the bad one, for every ten bytes of text."""
    parts = pieces(text)
    saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in parts)
    return 10 * saved / (sum(map(len, parts)) + 16)


def score(d: np.ndarray, weights) -> np.ndarray:
    """The curve, which never falls with the difference."""
    return 1 / (1 + np.exp(-np.clip(weights[0] + max(weights[1], 0.0) * d, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def sampled(docs: DataFrame, labels: DataFrame, counts: dict[int, int], per_class: int, max_chars: int) -> DataFrame:
    """(y, half, text): about 1.5 x per_class rows a class and half, from a bounded sample of the labels."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null")
    h = F.xxhash64("id")
    place = F.pmod(F.shiftright(h, 1), F.lit(1 << 30))
    drawn = [ids.filter((F.col("y") == y) & (place < int(min(1.0, 3 * per_class / n) * (1 << 30)))).dropDuplicates(["id"]).limit(6 * per_class) for y, n in counts.items()]
    some = drawn[0].unionByName(drawn[1]).withColumn("half", F.pmod(h, F.lit(2)).cast("int"))
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars))
    return written(texts.join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("y", "half", "text").dropDuplicates())  # 12 x per_class ids at most


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000) -> Model:
    """Fit on the given rows (text, quality); documents without a label or a text are not used."""
    known = labels.filter("quality in (0, 1)")
    counts = {int(r["quality"]): r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return Model(b"", b"", [], prior)
    rows = sampled(docs, known, counts, per_class, max_chars)

    def share(y: int, half: int) -> list[str]:
        order = F.xxhash64("text")
        return [r["text"] for r in rows.filter((F.col("y") == y) & (F.col("half") == half)).orderBy(order, "text").limit(per_class).collect()]

    def dictionary(y: int) -> bytes:
        parts = [p for t in share(y, 0) for p in pieces(t)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, parts, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # too few samples to choose from: the pieces themselves, in order
            return b"\n".join(parts)[-DICT_BYTES:] or b" " * 8

    model = Model(dictionary(1), dictionary(0), [], prior)
    g, b = model.compressors()
    curve = [(difference(t, g, b), y) for y in (0, 1) for t in share(y, 1)]
    discard(rows)
    if len({y for _, y in curve}) < 2:
        return model
    x = np.array([[1.0, d] for d, _ in curve])
    model.weights = fit(x, np.array([y for _, y in curve], float))
    # the curve saw the classes in the shares of the sample, not of the labels
    seen = np.mean([y for _, y in curve])
    model.weights[0] += float(np.log(prior / (1 - prior)) - np.log(seen / (1 - seen)))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches):
        model = shared.value
        if model.weights:
            good, bad = model.compressors()
        for b in batches:
            if model.weights:
                got = score(np.array([difference(t.as_py(), good, bad) for t in b.column(1)], np.float64), model.weights)
            else:
                got = np.full(b.num_rows, model.prior)
            yield pa.record_batch([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def held_out():
    """The fold that learning never sees: crc32 of the id modulo 4 is 2 (false for a null id)."""
    return F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()), table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
