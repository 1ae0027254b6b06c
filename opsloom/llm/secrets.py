"""Secret scans (operator 1, DataFrame functions only).

Three base patterns (assigned values, access ids, long hexadecimal strings) are found by regular expressions. A
randomness battery then judges every other token of 20 or more characters of a token alphabet:

* its encoding is inferred (hex, base32, alphanumeric, base64, base64url), which fixes the alphabet;
* chi-squared: how far the symbol counts are from uniform, against the non-centrality that text-like strings have;
* runs: how often the character class changes, against half of what a random string shows;
* serial correlation of neighbouring symbols, against a margin;
* the three are joined (Stouffer) into a p-value of "text-like".

False discoveries are controlled by Benjamini-Hochberg within each stratum of encoding and length class (a power of
two), since short tokens give the tests little power: a stratum's cut-off comes from a histogram of its p-values, a
table of bounded size. Random tokens that touch no base span are added as kind ``random``.

Plan: one scan writes a narrow table (ids, spans, token statistics; no text), one aggregation over it gives the
cut-offs, one projection over it gives the result. Nothing is shuffled but histogram rows, added up before.

Defined results: a null or empty text has no spans; repeated rows get repeated results; very long texts are scanned
whole; ties in start are ordered by kind; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import table, text_of, written
from opsloom.llm.rules import let

#: The patterns. Kinds are ordered as listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a match that is too short ends where its characters end, so asking for the length at once gives the same spans
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# '=' may stand before a token: it ends a key, and the padding of the token before is taken by that token
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"
MIN_ASSIGN = 6

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, pattern (without padding), alphabet, non-centrality a symbol that text-like strings have at least.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS, 1.0),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6], 1.0),
    ("HEX", r"^[0-9A-F]+$", DIGITS + UPPER[:6], 1.0),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 1.2),
    ("alnum", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 2.0),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 2.0),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 2.0),
    ("other", r"^", UPPER + LOWER + DIGITS + "+/-_", 2.0),
)
FALSE_DISCOVERY_RATE = 0.05
BINS_A_DECADE, MOST_DECADES = 10, 12
SERIAL_MARGIN = 0.35
_BLOCK = 256


def _sum(x: Column, zero=0) -> Column:
    return F.aggregate(x, F.lit(zero), lambda a, v: a + v)


def running_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks so that long arrays stay cheap."""

    def by_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / _BLOCK).cast("int")), lambda b: _sum(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))

        def at(_, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return block, i - block * _BLOCK

        def total(bs: Column) -> Column:
            def one(v, i):
                block, rest = at(v, i)
                return _sum(F.slice(bs, F.lit(1), block)) + _sum(F.slice(x, block * _BLOCK + 1, rest))

            return F.transform(x, one)

        return let(blocks, total)

    return let(lengths, by_blocks)


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, token, part) of all leftmost non-overlapping matches, in code points, end exclusive.

    The gaps between matches come from splitting by the same pattern, so positions are sums of lengths.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(m: Column) -> Column:
        steps = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(m)).alias("g"), m.alias("m")), lambda z: F.length(z["g"]) + F.length(z["m"]))

        def placed(b: Column) -> Column:
            zipped = F.arrays_zip(b.alias("b"), F.slice(gaps, F.lit(1), F.size(m)).alias("g"), m.alias("m"), parts.alias("p"))
            return F.transform(zipped, lambda z: F.struct((z["b"] + F.length(z["g"])).alias("start"), (z["b"] + F.length(z["g"]) + F.length(z["m"])).alias("end"), z["m"].alias("token"), z["p"].alias("part")))

        return let(running_before(steps), placed)

    return let(found, spans)


NO_SPANS = "array<struct<start:int,end:int,token:string,part:string>>"


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """Array of (start, kind index, end) of the base patterns, ordered by start, then kind."""
    assign = F.filter(_where((text.contains("=") | text.contains(":")) & text.rlike(ASSIGN), located(text, ASSIGN, 2)), lambda s: F.length(s["part"]) >= MIN_ASSIGN)
    access = _where(text.contains("AKIA") & text.rlike(ACCESS), located(text, ACCESS))
    long_hex = _where(text.rlike(HEX), located(text, HEX))

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(tagged(assign, 0), tagged(access, 1), tagged(long_hex, 2)))


def _phi(z: Column) -> Column:
    """Logistic form of the normal distribution function."""
    return 1 / (1 + F.exp(-F.greatest(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(60.0)), F.lit(-60.0))))


def _class_change(alphabet: str) -> float:
    """Chance that two random symbols differ in class (lower, upper, digit, other)."""
    kinds = [sum(c in s for c in alphabet) for s in (UPPER, LOWER, DIGITS)]
    kinds.append(len(alphabet) - sum(kinds))
    return 1 - sum((k / len(alphabet)) ** 2 for k in kinds)


def battery(token: Column, alphabet: str, margin: float) -> Column:
    """p-value of "text-like" of a token (padding removed) over an alphabet."""
    k, n = len(alphabet), F.length(token).cast("double")
    chars = F.split(token, "")
    squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2)))
    chi = k / n * squares - n
    z_chi = (k - 1 + n * margin - chi) / F.sqrt(2.0 * (k - 1) + 4 * n * margin)
    classes = F.translate(token, UPPER + LOWER + DIGITS, "U" * 26 + "l" * 26 + "9" * 10)
    change = _class_change(alphabet)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    if change > 0.05:
        z_runs = (runs - 1 - 0.5 * (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    else:
        z_runs = F.lit(0.0)
    values = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double") - (k + 1) / 2)
    spread = (k * k - 1) / 12.0
    products = let(values, lambda v: F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    serial = products / (spread * n)
    z_serial = SERIAL_MARGIN * F.sqrt(n) - F.abs(serial) * F.sqrt(n)
    return 1 - _phi((z_chi + z_runs + z_serial) / (3**0.5))


def judged_tokens(text: Column, base: Column) -> Column:
    """Array of (start, end, stratum, bin): candidate tokens outside base spans with the bin of -log10 p."""
    tokens = _where(text.rlike(TOKEN), located(text, TOKEN))
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def judge(t: Column) -> Column:
        def with_core(core: Column) -> Column:
            name, p = None, None
            for enc, pattern, alphabet, margin in reversed(ENCODINGS):
                value = battery(core, alphabet, margin)
                name = F.lit(enc) if name is None else F.when(core.rlike(pattern), F.lit(enc)).otherwise(name)
                p = value if p is None else F.when(core.rlike(pattern), value).otherwise(p)
            stratum = F.concat(name, F.lit(":"), F.floor(F.log2(F.length(core))).cast("string"))
            decades = F.least(-F.log10(F.greatest(p, F.lit(1e-30))), F.lit(float(MOST_DECADES)))
            return F.struct(t["start"].alias("start"), t["end"].alias("end"), stratum.alias("stratum"), F.floor(decades * BINS_A_DECADE).cast("int").alias("bin"))

        return let(F.regexp_replace(t["token"], "=+$", ""), with_core)

    return F.transform(free, judge)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, tokens of every document: narrow, without text."""
    text = text_of()
    return docs.select("doc_id", base_spans(text).alias("base"), text.alias("t")).select("doc_id", "base", judged_tokens(F.col("t"), F.col("base")).alias("tokens"))


def cut_offs(tokens: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> dict[str, int]:
    """Lowest accepted bin of each stratum: Benjamini-Hochberg on the histogram of p-values.

    At most encodings x length classes rows come to the driver.
    """
    bins = tokens.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    above = W.partitionBy("stratum").orderBy(F.desc("bin"))
    bins = bins.withColumn("found", F.sum("n").over(above)).withColumn("all", F.sum("n").over(W.partitionBy("stratum")))
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE)
    accepted = bins.filter(F.col("all") * largest_p <= rate * F.col("found")).filter(~F.col("stratum").startswith("decimal"))
    return {r["stratum"]: r["least"] for r in accepted.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def with_random(scanned: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds ``spans``: base spans and the accepted random tokens, ordered."""
    if limits:
        least = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
        hits = F.filter("tokens", lambda t: t["bin"] >= F.coalesce(F.try_element_at(least, t["stratum"]), F.lit(1 << 20)))
        added = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
        return scanned.withColumn("spans", F.array_sort(F.concat("base", added)))
    return scanned.withColumn("spans", F.col("base"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end) of every document."""
    scanned = written(scan(docs))
    return with_random(scanned, cut_offs(scanned)).select("doc_id", "base", "spans")


def redact(spark, docs: DataFrame, sf_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: every secret found is replaced by a mark; documents stay, and n_chars follows the text.

    Token statistics are written once for the cut-offs; the second scan then judges each text next to itself, so texts
    are not joined.
    """
    limits = cut_offs(written(scan(docs).select("tokens").filter(F.size("tokens") > 0)))
    text = text_of()
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"), base_spans(text).alias("base"))
    judged = with_random(row.withColumn("tokens", judged_tokens(text, F.col("base"))), limits)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    hit = F.size("spans") > 0
    out = judged.select("row", hit.alias("hit"), F.when(hit, clean).otherwise(F.col("text")).alias("new"))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.col("new").alias(name)
        if name == "n_chars":
            return F.when(F.col("hit"), F.length("new").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*[column(c) for c in names])


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of all documents."""
    found = find(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), count(3).alias("n_random"))
