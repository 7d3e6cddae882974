"""Column builders shared by the operators; everything here stays on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: white space as the Unicode-aware regex class sees it.
WS = r"[ \t\n\r\f\x0B\x{85}\x{A0}]"

# Fixed value: pre-token shapes of the o200k vocabulary, without look-ahead. A
# token never holds a non-space character followed by white space, so counts add
# up over white-space joints: n(a + s + b) = n(a) + n(s + b).
TOKEN_PATTERN = (
    r"[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+|\p{N}{1,3}"
    r"| ?[^ \t\n\r\f\p{L}\p{N}]+|[ \t\n\r\f]+"
)

# Fixed value: searchable terms are runs of letters, marks and numbers.
TERM_PATTERN = r"[\p{L}\p{M}\p{N}]+"

# Fixed value: the RFC 4122 namespace for URL names.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

TokenCounter = Callable[[Column], Column]


def token_count(text: Column) -> Column:
    """Pre-token count: a lower bound on byte-pair tokens that needs no rank file."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("int")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def search_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def unfold(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of ``items``.

    The outer generator is used because the plain one makes the optimizer push a
    ``size(items) > 0`` filter below, which evaluates the whole array twice.
    """
    if position:
        spread = df.select(*keep, F.posexplode_outer(items).alias(position, name))
        return spread.filter(F.col(position).isNotNull())
    spread = df.select(*keep, F.explode_outer(items).alias(name))
    return spread.filter(F.col(name).isNotNull())


def json_text(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    encoded = F.to_json(F.struct(text.alias("t")))
    return F.substring(encoded, F.lit(6), F.length(encoded) - 6)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based identifier: sha1 of namespace bytes and name, version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def rounded(value: Column, digits: int = 6) -> Column:
    """Round before ranking, so that the order of float additions cannot matter."""
    return F.round(value, digits)
