"""Personal data by base patterns and a semi-Markov conditional random field (operator 7).

Four base patterns give e-mail addresses, network addresses, payment cards and phone numbers. In the stretches of a
text that hold several digits or an at-sign, a semi-Markov CRF scores whole candidate spans (digit grouping, checksum,
separators, neighbours) for each type, and a dynamic program over at most ``LONGEST`` tokens a span chooses boundaries
and types together. Spans it finds apart from base spans are added. A candidate has at most ``LONGEST_CHARS`` characters.

The field is trained here by gradient steps on its log likelihood: on stretches of a bounded sample of documents
(``max_windows``), labelled by the base patterns, and on a fixed set of made-up variants (numbers without a country code, other
separators, and dates, versions and plain numbers as negatives). Scoring is one pass in Arrow batches, no shuffle.

Defined results: a null or empty text has no spans; matches that fail their check are dropped and not retried;
very long texts are read whole (each stretch takes time in proportion to its tokens, each span found one bisection); repeated rows get repeated results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with a left bound that spares useless starts.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

#: Stretches that the field reads, and what it takes as a token.
STRETCH = re.compile(r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*|[+(]*[0-9][0-9().+/:\x20-]*[0-9]")
LEAST_DIGITS, LONGEST, LONGEST_CHARS = 7, 20, 400
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, for any number of leading zeros."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def emails(text: str):
    """Leftmost non-overlapping matches, read off around each at-sign."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered."""
    if not text or not TRIGGER.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def stretches(text: str):
    """(start, end) of the parts that the field reads: an at-sign, or seven digits and more."""
    if not text or not TRIGGER.search(text):
        return
    for m in STRETCH.finditer(text):
        if "@" in m[0] or (m.end() - m.start() >= LEAST_DIGITS and len(DIGIT.findall(m[0])) >= LEAST_DIGITS):
            yield m.start(), m.end()


@lru_cache(maxsize=10_000)
def features(span: str, before: str, after: str) -> tuple[str, ...]:
    """Whole-span features of a candidate; neighbours are a character class each."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", span))))
    shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 20)), re.sub(r"[A-Za-z]+", "a", span)) if len(groups) <= 6 else "long"
    out = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 8)}", f"seps={seps}", f"before={before}", f"after={after}", f"first={span[0] if not span[0].isalnum() else 'x'}"]
    if "@" in span:
        left, _, right = span.partition("@")
        out.append(f"mail={bool(left)}{right.count('.') > 0}{span.count('@')}{right[-1:].isalnum()}")
    else:
        out.append(f"shape={shape}")
        if 14 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}")
        if len(groups) == 4 and seps == ".":
            out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return tuple(out)


def _class(c: str) -> str:
    return "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+(.-@/:" else "other"


def candidates(text: str, start: int, end: int):
    """Tokens' bounds and the (i, j, features) of the spans that may be an entity, of LONGEST tokens and LONGEST_CHARS at most."""
    bounds = [m.start() for m in TOKEN.finditer(text, start, end)] + [end]
    spans = []
    for i in range(len(bounds) - 1):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+(._%"):
            continue
        for j in range(i + 1, min(i + LONGEST, len(bounds) - 1) + 1):
            if bounds[j] - bounds[i] > LONGEST_CHARS:
                break
            s = text[bounds[i] : bounds[j]]
            if not s[-1].isalnum() or not ("@" in s or len(s) >= LEAST_DIGITS):
                continue
            spans.append((i, j, features(s, _class(text[bounds[i] - 1 : bounds[i]]), _class(text[bounds[j] : bounds[j] + 1]))))
    return bounds, spans


class Field:
    """Weights of the semi-Markov field; a token outside any entity scores 0."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}

    def scores(self, feats) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights.get(f, zero) for f in feats), zero)

    def best(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities on the best path."""
        bounds, spans = candidates(text, start, end)
        n, ending = len(bounds) - 1, {}
        for i, j, f in spans:
            s = self.scores(f)
            k = int(np.argmax(s))
            ending.setdefault(j, []).append((i, k, float(s[k])))
        top, back = [0.0] + [0.0] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for i, k, s in ending.get(j, ()):
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if back[j]:
                i, k = back[j]
                out.append((bounds[i], k, bounds[j]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def step(self, text: str, start: int, end: int, gold: set, rate: float) -> None:
        """One gradient step on the log likelihood of the gold spans of a stretch."""
        bounds, spans = candidates(text, start, end)
        if not spans:
            return
        n, scored = len(bounds) - 1, [self.scores(f) for *_, f in spans]
        ending, starting = {}, {}
        for x, (i, j, _) in enumerate(spans):
            ending.setdefault(j, []).append(x)
            starting.setdefault(i, []).append(x)
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *[alpha[spans[x][0]] + s for x in ending.get(j, ()) for s in scored[x]]])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *[beta[spans[x][1]] + s for x in starting.get(i, ()) for s in scored[x]]])
        for x, (i, j, f) in enumerate(spans):
            gradient = -np.exp(np.minimum(alpha[i] + scored[x] + beta[j] - alpha[n], 0))
            for k in range(len(KINDS)):
                if (bounds[i], k, bounds[j]) in gold:
                    gradient[k] += 1
            if np.abs(gradient).max() > 1e-3:
                for name in f:
                    self.weights[name] = self.weights.get(name, 0) * (1 - 1e-3) + rate * gradient


def variants(seed: int = 7, each: int = 12) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up stretches with their spans: forms that the base patterns miss, and numbers that are no personal data."""
    rnd = random.Random(seed)

    def d(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        head = rnd.choice("345") + d(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    out = []
    for _ in range(each):
        c = card()
        whole = [(3, f"({d(3)}) {d(3)}-{d(4)}"), (3, f"{d(3)}-{d(3)}-{d(4)}"), (3, f"{d(3)}.{d(3)}.{d(4)}"), (3, f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"), (3, f"+{d(2)} {d(3)} {d(7)}"), (2, c), (2, "-".join(c[i : i + 4] for i in range(0, 16, 4)))]
        whole += [(1, ".".join(str(rnd.randint(0, 255)) for _ in range(4))), (0, f"{rnd.choice(['ann', 'bob.k', 'c_d'])}.{d(2)}@{rnd.choice(['mail', 'post'])}{d(1)}.example.com")]
        for kind, s in whole:
            out.append((f"to {s} or", [(3, kind, 3 + len(s))]))
        out.append((f"to {whole[0][1]} {c} or", [(3, 3, 3 + len(whole[0][1])), (4 + len(whole[0][1]), 2, 20 + len(whole[0][1]))]))
        for s in (f"20{d(2)}-0{rnd.randint(1, 9)}-1{d(1)}", f"{d(5)}.{d(4)}", f"{d(8)}", f"{d(12)}", f"{d(16)}", f"{d(4)} {d(4)} {d(3)}", f"{d(2)}.{d(3)}.{d(5)}", f"1{d(1)}:{d(2)}:{d(2)} 20{d(2)}", f"{d(3)} {d(3)} {d(3)}", "@" + d(2), f"{d(4)}-{d(4)}", f"{d(2)}/{d(2)}/{d(4)}"):
            out.append((f"to {s} or", []))
    return out


def train(docs: DataFrame, max_windows: int = 400, rounds: int = 5) -> Field:
    """Fit on stretches of a bounded sample of documents and on the variants."""

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                for s, e in stretches(text):
                    if e - s <= 120:
                        lo, hi = max(0, s - 2), min(len(text), e + 2)
                        gold = [x for x in base if x[0] >= s and x[2] <= e]
                        found.append((text[lo:hi], s - lo, e - lo, [v for x in gold for v in (x[0] - lo, x[1], x[2] - lo)]))
            yield pa.record_batch([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], names=["text", "s", "e", "gold"])

    rows = docs.select("text").filter(F.col("text").rlike("[0-9@]")).mapInArrow(run, "text string, s int, e int, gold array<int>")
    sample = rows.orderBy(F.xxhash64("text"), "text", "s").limit(max_windows).collect()
    work = [(r["text"], r["s"], r["e"], {tuple(r["gold"][i : i + 3]) for i in range(0, len(r["gold"]), 3)}) for r in sample]
    for text, spans in variants():
        for s, e in stretches(text):
            work.append((text, s, e, {x for x in spans if x[0] >= s and x[2] <= e}))
    field, rnd = Field(), random.Random(11)
    for k in range(rounds):
        rnd.shuffle(work)
        for text, s, e, gold in work:
            field.step(text, s, e, gold, 0.3 / (1 + k))
    return field


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    starts, reach, added = [b[0] for b in base], list(accumulate((b[2] for b in base), max)), []

    def covered(before: int) -> int:
        """How far the base spans reach that start before a place."""
        k = bisect_left(starts, before)
        return reach[k - 1] if k else 0

    for s, e in stretches(text):
        if covered(s + 1) >= e:  # the whole stretch lies in one base span
            continue
        added += [x for x in field.best(text, s, e) if covered(x[2]) <= x[0]]
    return base, sorted(base + added)


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some thousand weights
    kept = small_batches(docs).select("doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches):
        field = shared.value
        for b in batches:
            found = [all_spans(t.as_py() or "", field) for t in b.column(1)]
            columns = [pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x[i]] for x in found], kind) for i in (0, 1)]
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:int,kind:string,end:int>>"
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all documents; counts are of base spans."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))

    def text_of(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text_of("base").cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
