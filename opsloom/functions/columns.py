"""Column expressions shared by the operators: identities, ladders, thresholds, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The severity ladder, lowest first.
SEVERITIES = ("info", "warning", "high", "critical", "blocking")
#: Fixed value: name space of the deterministic envelope ids (RFC 4122, URL).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 12 hex digits of the sha256 of the parts, joined by a pipe; null parts read as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, 12))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def severity_rank(severity: Column, cap: str | None = None) -> Column:
    """Place on the ladder from 0; unknown values are the floor; ``cap`` bounds it from above."""
    rank = F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1, F.lit(0)), F.lit(0))
    return rank if cap is None else F.least(rank, F.lit(SEVERITIES.index(cap)))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def violation_limit(threshold: Column) -> Column:
    """Largest share of violations that a threshold text allows: ``>=99%`` and ``<=1%`` forms; other forms are null."""
    number = F.regexp_extract(threshold, r"([0-9]+(?:\.[0-9]+)?)\s*%?\s*$", 1).try_cast("double")
    value = F.when(threshold.contains("%"), number / 100).otherwise(number)
    return F.round(F.when(threshold.rlike(r"^\s*>="), 1 - value).when(threshold.rlike(r"^\s*<="), value), 10)


def rule_status(numerator: Column, denominator: Column, limit: Column) -> Column:
    """``violated`` when the share is above the limit; nothing measured passes."""
    return F.when(denominator <= 0, F.lit("passed")).when(numerator / denominator > limit, F.lit("violated")).otherwise(F.lit("passed"))


def volume_band(rows: Column) -> Column:
    """Power of two below the row count; null for none."""
    return F.when(rows > 0, F.floor(F.log2(rows))).cast("int")


def normalized_job(name: Column) -> Column:
    """A job's name without an environment prefix in brackets or suffix, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\[[^\]]+\]\s*", ""), r"-(dev|staging|prod)$", "")
    return F.lower(F.trim(bare))


def error_class(status: Column) -> Column:
    """transient (no status, 5xx, 408, 429) or permanent."""
    return F.when(status.isNull() | (status >= 500) | status.isin(408, 429), F.lit("transient")).otherwise(F.lit("permanent"))


def duration_seconds(text: Column) -> Column:
    """Seconds of a literal such as 30m or 24h; null if malformed."""
    unit = F.regexp_extract(text, r"^\d+([smhd])$", 1)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.regexp_extract(text, r"^(\d+)[smhd]$", 1).try_cast("long") * size


def share(part: Column, whole: Column) -> Column:
    """part / whole, null when there is nothing to share."""
    return F.when(whole != 0, part / whole)


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, trailing zeros removed, so that arrays compare as versions do."""
    trimmed = F.regexp_replace(F.regexp_extract(version, r"^\s*v?([0-9]+(?:\.[0-9]+)*)", 1), r"(\.0+)+$", "")
    return F.transform(F.filter(F.split(trimmed, r"\."), lambda p: p != ""), lambda p: p.cast("long"))


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile of an array by the exclusive method: position q * (n + 1), interpolated and kept inside the range."""
    s, n = F.array_sort(values), F.size(values)
    at = F.lit(q) * (n + 1)
    low = F.greatest(F.least(F.floor(at), n - 1), F.lit(1)).cast("int")
    return F.when(n == 0, None).when(n == 1, F.element_at(s, 1)).otherwise(F.element_at(s, low) + (at - low) * (F.element_at(s, low + 1) - F.element_at(s, low)))
