"""Text functions as Spark columns (null in, null out, unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """TXT-1: plain spaces and hyphens, runs of blanks as one, at most one empty line, no white space at either end."""
    plain = F.translate(text, " ‑", " -")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """FN-S2: runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, most: int = 40, fallback: str = "sec") -> Column:
    """TXT-7: lower case, runs of other characters than letters and digits as one hyphen, at most so many characters."""
    hyphened = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(hyphened, "^-+|-+$", ""), 1, most), F.lit("")), F.lit(fallback))


def normal(text: Column) -> Column:
    """TXT-14: lower case, section marks and dashes as spaces, white space squeezed."""
    return F.lower(F.regexp_replace(F.translate(text, "§—–", "   "), r"\s+", " "))


def only_words(text: Column) -> Column:
    """TXT-14: letters a-z and digits of the lower-cased text, nothing else; for matching quotes."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def tokens(text: Column, pattern: str = "[a-z]+") -> Column:
    """FN-S12: distinct matches of a pattern in the lower-cased text, in order of first appearance; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)))


def words(text: Column) -> Column:
    """TXT-11: words by white space, the stand-in tokenizer; empty for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def windows(n: Column, size: int, overlap: int) -> Column:
    """TXT-9: starts (from 0) of overlapping windows over n tokens: one window if n fits, else every size - overlap."""
    step = max(1, size - overlap)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))


def listed(text: Column, pattern: str = ";") -> Column:
    """PRJ-4 and PRJ-5: members of a separated list, trimmed, without empty ones and the text nan."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: (x != "") & (x != "nan"))


def truthy(text: Column) -> Column:
    """PRJ-6: true for 1, true and yes in any case; false for all else and null."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def within(value: Column, low: int, high: int) -> Column:
    """PRJ-8: the value as an integer if it is one from low to high, else null."""
    n = F.try_to_number(F.when(F.trim(value.cast("string")).rlike(r"^-?\d{1,9}$"), F.trim(value.cast("string"))), F.lit("S999999999")).cast("int")
    return F.when(n.between(low, high), n)


def one_of(value: Column, domain: list[str], default: str) -> Column:
    """PRJ-7: the value if the domain holds it, else the default."""
    return F.when(value.isin(domain), value).otherwise(F.lit(default))


def sentences(text: Column) -> Column:
    """FN-S11: sentences and lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """TXT-13: paragraphs between blank lines, lines joined by spaces, headings of fewer than eight words left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), squeeze)
    return F.filter(parts, lambda p: (p != "") & ~(p.startswith("#") & (F.size(F.split(p, " ")) < 8)))


def luhn(digits: Column) -> Column:
    """FN-M1: Luhn check of a string of digits; false for any other text."""
    return F.call_function("luhn_check", digits)


def weighted_check(digits: Column) -> Column:
    """FN-M2: of seven digits, the 1st, 3rd and 5th plus twice the 2nd, 4th and 6th end in the 7th; false for any other text."""
    d = [F.substring(digits, k, 1).try_cast("int") for k in range(1, 8)]
    return F.coalesce(digits.rlike("^[0-9]{7}$") & ((d[0] + d[2] + d[4] + (d[1] + d[3] + d[5]) * 2) % 10 == d[6]), F.lit(False))


def prefixed_luhn(digits: Column, prefix: str = "80840") -> Column:
    """FN-M3: Luhn check of ten digits after an issuer's prefix; false for any other text."""
    return F.coalesce(digits.rlike("^[0-9]{10}$") & F.call_function("luhn_check", F.concat(F.lit(prefix), digits)), F.lit(False))


def hits_of(text: Column, phrases: list[str]) -> Column:
    """FN-S3: the phrases found in the lower-cased text between word boundaries, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.rlike(r"\b" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in p) + r"\b"), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*found))


def any_of(text: Column, phrases: list[str], words: bool = True) -> Column:
    """FN-S3, FN-S14: whether the lower-cased text holds any phrase, between word boundaries or anywhere; one pattern, false for null."""
    inner = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in p) for p in phrases)
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{inner})\b" if words else inner), F.lit(False))


def parts_of(text: Column, phrases: list[str]) -> Column:
    """FN-S14: the phrases that the lower-cased text contains anywhere, in the order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]))
