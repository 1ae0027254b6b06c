"""The randomness battery and its false-discovery control restated plainly, and false finds measured on text without secrets."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opsloom.llm import secrets as S

WORDS = "get set user name order value list item house river stone config manager service handler request response table index update create delete customer total price amount current previous internal external default settings version backup archive report monthly yearly account billing address street number document template".split()


def plain_p(token, alphabet, margin):
    """The three tests and their joined p-value, symbol by symbol."""
    k, n = len(alphabet), len(token)
    counts = Counter(token)
    chi = sum((counts[c] - n / k) ** 2 / (n / k) for c in alphabet)
    z_chi = (k - 1 + n * margin - chi) / math.sqrt(2 * (k - 1) + 4 * n * margin)
    kind = lambda c: "U" if c in S.UPPER else "l" if c in S.LOWER else "9" if c in S.DIGITS else c
    share = Counter("o" if kind(c) not in "Ul9" else kind(c) for c in alphabet)
    change = 1 - sum((x / k) ** 2 for x in share.values())
    runs = 1 + sum(kind(a) != kind(b) for a, b in zip(token, token[1:], strict=False))
    z_runs = (runs - 1 - (n - 1) * change / 2) / math.sqrt((n - 1) * change * (1 - change)) if change > 0.05 else 0.0
    place = [alphabet.index(c) + 1 - (k + 1) / 2 for c in token]
    serial = sum(a * b for a, b in zip(place, place[1:], strict=False)) / ((k * k - 1) / 12 * n)
    z_serial = S.SERIAL_MARGIN * math.sqrt(n) - abs(serial) * math.sqrt(n)
    z = (z_chi + z_runs + z_serial) / math.sqrt(3)
    return 1 - 1 / (1 + math.exp(-max(min(1.5976 * z + 0.070566 * z**3, 60), -60)))


def judged(token):
    """(stratum, -log10 p) of a token."""
    core = token.rstrip("=")
    name, _, alphabet, margin = next(e for e in S.ENCODINGS if re.match(e[1], core))
    return f"{name}:{int(math.log2(len(core)))}", min(-math.log10(max(plain_p(core, alphabet, margin), 1e-30)), S.MOST_DECADES)


def styles(rnd):
    """A text-like token of 20 characters or more in some style of identifiers, paths and slugs."""
    while True:
        some = [rnd.choice(WORDS) for _ in range(rnd.randint(3, 8))]
        style = rnd.randrange(6)
        out = ["_".join(some), "-".join(some), "".join(w.capitalize() for w in some), "/".join(some), "".join(some) + str(rnd.randint(1, 2030)), "_".join(some).upper()][style]
        if len(out) >= 20:
            return out


def secret(rnd, n):
    return "".join(rnd.choice(string.ascii_letters + string.digits + rnd.choice(["", "+/", "-_"])) for _ in range(n))


def tokens_of(spark, tokens):
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "doc_id long, text string")
    return docs, S.scan(docs).cache()


def test_battery_restated(spark):
    rnd = random.Random(1)
    tokens = [styles(rnd) for _ in range(150)] + [secret(rnd, rnd.randint(20, 90)) for _ in range(100)]
    tokens += ["".join(rnd.choice(a) for _ in range(rnd.randint(20, 70))) for a in ("0123456789", "0123456789abcdef", "0123456789ABCDEF", S.UPPER + "234567") for _ in range(20)] + ["a" * 30, "ab" * 20, secret(rnd, 40) + "=="]
    _, scanned = tokens_of(spark, tokens)
    got = {r.doc_id: r.tokens for r in scanned.collect()}
    checked = 0
    for i, t in enumerate(tokens):
        for found in got[i]:
            stratum, decades = judged(t)
            assert found.stratum == stratum and abs(found.bin - decades * S.BINS_A_DECADE) <= 1 + 1e-6, (t, found, decades)
            checked += 1
    assert checked > 230


def test_false_discovery_control_restated(spark):
    """Benjamini-Hochberg on the binned p-values of each stratum."""
    rnd = random.Random(2)
    tokens = [styles(rnd) for _ in range(300)] + [secret(rnd, rnd.randint(20, 60)) for _ in range(60)]
    _, scanned = tokens_of(spark, tokens)
    bins = defaultdict(list)
    for r in scanned.collect():
        for t in r.tokens:
            bins[t.stratum].append(t.bin)
    want = {}
    for stratum, some in bins.items():
        passing = [b for b in set(some) if len(some) * 10 ** (-b / S.BINS_A_DECADE) <= S.FALSE_DISCOVERY_RATE * sum(x >= b for x in some)]
        if passing and not stratum.startswith("decimal"):
            want[stratum] = min(passing)
    assert want and S.cut_offs(scanned) == want


def test_text_without_secrets_gives_next_to_no_finds(spark):
    """The null corpus: 3,000 text-like tokens. Of every length class under 1 % is taken for random (the rate is 5 %)."""
    rnd = random.Random(3)
    tokens = [styles(rnd) for _ in range(3000)]
    docs, scanned = tokens_of(spark, tokens)
    found = S.with_random(scanned, S.cut_offs(scanned)).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == 3)).alias("n")).collect()
    many, false = Counter(), Counter()
    for r in found:
        c = int(math.log2(len(tokens[r.doc_id])))
        many[c] += 1
        false[c] += r.n
    assert all(false[c] <= 0.01 * many[c] for c in many), (many, false)


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_finds_among_text(spark, share):
    """Random tokens among text-like ones: the share of false finds stays near the rate, and long secrets are found."""
    rnd = random.Random(4)
    real = [rnd.random() < share for _ in range(3000)]
    tokens = [secret(rnd, rnd.choice([24, 32, 40, 64])) if x else styles(rnd) for x in real]
    docs, scanned = tokens_of(spark, tokens)
    hit = {r.doc_id for r in S.with_random(scanned, S.cut_offs(scanned)).select("doc_id", F.size("spans").alias("n")).collect() if r.n}
    false = sum(not real[i] for i in hit)
    assert hit and false <= 0.07 * len(hit), (false, len(hit))
    long = [i for i, t in enumerate(tokens) if real[i] and len(t) >= 40]
    assert sum(i in hit for i in long) >= 0.9 * len(long), (sum(i in hit for i in long), len(long))
