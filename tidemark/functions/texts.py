"""Functions of commit messages, names, addresses and secret values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and local parts that many people share.
GENERIC_NAMES = ["unknown", "user", "admin", "root", "dev", "developer", "your name", "github-actions[bot]", "dependabot[bot]"]
GENERIC_LOCAL_PARTS = ["info", "dev", "team", "admin", "hello", "mail", "no-reply", "noreply", "git", "build", "ci"]
NOREPLY = r"^[0-9]+\+([^@]+)@users\.noreply\.github\.com$"


def is_fix(message: Column) -> Column:
    return message.rlike(r"(?i)\b(fix|bug|patch|resolve|close[sd]?)\b")


def is_revert(message: Column) -> Column:
    return message.rlike(r"(?i)^\s*revert\b")


def fix_confidence(message: Column) -> Column:
    strong, weak = message.rlike(r"(?i)\b(fix|bug|patch|resolve)\b"), message.rlike(r"(?i)\bclose[sd]?\b")
    return F.when(~(strong | weak), 0.0).when(message.rlike(r"#\d+"), 1.0).when(strong, 0.7).otherwise(0.3)


def signature(category: Column | str, key: Column) -> Column:
    """32 hex digits that name a finding across runs."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(category) if isinstance(category, str) else category, key), 256), 1, 32)


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def is_bot(name: Column) -> Column:
    return normal_name(name).endswith("[bot]")


def mask_email(email: Column) -> Column:
    """First character, three stars and the domain; never the address itself."""
    local, domain = F.regexp_extract(email, "^([^@]*)", 1), F.regexp_extract(email, "(@.*)$", 1)
    return F.when(email == "", email).otherwise(F.concat(F.substring(local, 1, 1), F.lit("***"), domain))


def redact(value: Column) -> Column:
    v = F.trim(value)
    return F.when(F.length(v) >= 12, F.concat(F.substring(v, 1, 4), F.lit("*" * 16), F.substring(v, -2, 2)))


def fingerprint(salt: str, rule: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), rule, F.lit(":"), F.trim(value)), 256)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for ''."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n)))


def parse_time(text: Column) -> Column:
    """ISO time; with an offset that cannot be, the time itself as UTC."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 19)))
