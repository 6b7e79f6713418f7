"""Scalar functions of the engine as Column expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a text or a key as secret.
SECRET_MARKERS = ("password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "credential", "authorization", "bearer")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def holds_secret(c: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(c), F.lit("|".join(SECRET_MARKERS))), F.lit(False))


def safe_summary(c: Column, most: int = 160) -> Column:
    """The collapsed text, cut; null if it is empty or holds a secret marker."""
    short = F.substring(collapse(c), 1, most)
    return F.when((short != "") & ~holds_secret(c), short)


def slugify(c: Column, most: int = 64) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^A-Za-z0-9_-]+", "-"), F.lit("-")), 1, most)


def unicode_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def anchor(c: Column) -> Column:
    """A heading's anchor: lower case, punctuation dropped, blanks as dashes."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s_-]+", "")
    return F.regexp_replace(kept, r"\s", "-")


def strip_html(c: Column) -> Column:
    no_code = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return collapse(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "))


URL = r"https?://[^\s<>\"')\]]+"


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def redact_url(c: Column) -> Column:
    """Without login, and with the values of secret query fields hidden."""
    no_login = F.regexp_replace(c, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]*@", "$1<redacted>@")
    return F.regexp_replace(no_login, r"(?i)([?&][^=&#]*(?:token|secret|passw|key|auth|signature)[^=&#]*=)[^&#]*", "$1<redacted>")


def truncated(c: Column, most: int = 500, keep: int = 485, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep), F.lit(mark))).otherwise(c)


def scalar_type(c: Column) -> Column:
    v = F.trim(c)
    full = lambda p: F.regexp_like(v, F.lit(f"^(?:{p})$"))
    return (
        F.when(c.isNull() | (v == ""), F.lit("empty"))
        .when(F.lower(v).isin("true", "false"), F.lit("boolean"))
        .when(full(r"[+-]?\d+"), F.lit("integer"))
        .when(full(r"[+-]?\d+\.\d+"), F.lit("decimal"))
        .when(F.regexp_like(v, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.lit("date-like"))
        .when(F.regexp_like(v, F.lit(r"^https?://")), F.lit("url-like"))
        .otherwise(F.lit("text"))
    )


def column_types(cells: DataFrame, column: str, value: str) -> DataFrame:
    """(column, type_summary, non_empty): the one type of a column's cells, `mixed`, or `empty`."""
    t = F.col("t")
    some = F.when(t != "empty", t)
    done = cells.withColumn("t", scalar_type(F.col(value))).groupBy(column).agg(F.min(some).alias("a"), F.max(some).alias("b"), F.count(some).alias("non_empty"))
    kind = F.when(F.col("a").isNull(), F.lit("empty")).when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit("mixed"))
    return done.select(column, kind.alias("type_summary"), "non_empty")


def secret_key(c: Column) -> Column:
    """Whether a key's letters and digits hold a secret marker."""
    squashed = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.regexp_like(squashed, F.lit("|".join(m.replace("_", "") for m in SECRET_MARKERS)))


def value_summary(c: Column) -> Column:
    return F.when((F.length(c) <= 120) & F.regexp_like(c, F.lit(r"^[\x20-\x7E]*$")), c).otherwise(F.concat(F.lit("<string:"), F.length(c).cast("string"), F.lit(">")))


def normal_address(c: Column) -> Column:
    """local@domain in lower case, of an address with or without a display name."""
    inner = F.coalesce(F.nullif(F.regexp_extract(c, r"<([^<>]+)>", 1), F.lit("")), c)
    return F.lower(F.trim(inner))


def variable_reads(line: Column) -> Column:
    """Distinct $NAME and ${NAME...} of a shell line, in order."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def pointer(*segments: Column) -> Column:
    """RFC 6901 pointer of the segments."""
    esc = [F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) for s in segments]
    return F.concat(*(F.concat(F.lit("/"), e) for e in esc)) if esc else F.lit("")


def parsed_date(c: Column) -> Column:
    """RFC 822 and ISO dates as UTC ISO text, null for others."""
    plain = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")  # Spark parses no names of days
    zoned = F.regexp_replace(plain, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    formats = ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(zoned, F.lit(f)) for f in formats)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
