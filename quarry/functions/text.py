"""Text functions as Column expressions: cleaning, folding, stemming, tokens, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Single letters up to U+024F that fold to one ASCII letter under compatibility decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for i in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_FROM, _TO = _fold_table()

#: Scores are compared at so many digits: it takes off what the order of additions adds, and nothing else.
DIGITS = 12

#: Texts that stand for a missing value.
MISSING = ("nan", "none", "null", "na")


def fold(c: Column) -> Column:
    """Accents off, other non-ASCII characters dropped, lower case. Ligatures and full-width forms are dropped, not spelled out."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _FROM, _TO), r"[^\x00-\x7F]", ""))


def fold_exact(c: Column) -> Column:
    """fold() by full Unicode decomposition, in Arrow batches; for text with ligatures, fractions or full-width forms."""
    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())

    return folded(c)


def stem(t: Column) -> Column:
    """One suffix off: ing, ers, ies and ied (to y), ed, es, s; the rest must keep over three letters."""
    n = F.length(t)
    out = None
    for suffix in ("ing", "ers", "ies", "ied", "ed", "es", "s"):
        k = len(suffix)
        base = t.substr(F.lit(1), n - k)
        cond = (n > k + 3) & t.endswith(suffix)
        value = F.concat(base, F.lit("y")) if suffix in ("ies", "ied") else base
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(t)


def tokens(c: Column) -> Column:
    """Stemmed runs of letters and digits of the folded text, in order."""
    return F.transform(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)), stem)


def safe_text(c: Column) -> Column:
    """Trimmed of all Unicode white space; null and texts that stand for missing are ''."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(t).isin(*MISSING), "").otherwise(t)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def split_list(c: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty, distinct items in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(safe_text(c), sep), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))


def clean_list(c: Column) -> Column:
    return F.array_join(split_list(c), ", ")


def loose_list(c: Column) -> Column:
    """Trimmed, non-empty items, repeats included, of a text that is separated by , ; or |, or of a list literal of quoted or plain items."""
    text = F.trim(F.coalesce(c, F.lit("")))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    literal = F.regexp_extract_all(text, F.lit(r"'([^']*)'|\"([^\"]*)\"|([^\[\],'\"]+)"), F.lit(0))
    unquoted = F.transform(literal, lambda x: strip(F.regexp_replace(x, r"^['\"]|['\"]$", "")))
    items = F.when(text.startswith("[") & text.endswith("]"), unquoted).otherwise(F.transform(F.split(text, "[|,;]"), strip))
    return F.filter(items, lambda x: x != "")


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(safe_text(c)).isin("true", "1", "yes"), F.lit(False))


def to_double(c: Column, default: float | None = 0.0) -> Column:
    """A finite number, else the default."""
    d = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d), F.lit(default))


def to_int(c: Column, default: int = 0) -> Column:
    """Truncated, as an integer cast of a float is; the default for what isn't a finite number of that size."""
    return F.coalesce(to_double(c, None).try_cast("int"), F.lit(default))


def year_of(date: Column) -> Column:
    """Year of a date written year-month-day, also without leading zeros; null otherwise."""
    return F.year(F.try_to_timestamp(date, F.lit("yyyy-M-d")))


def decade(year: Column) -> Column:
    """The year's decade as in `1990s`, '' without a year."""
    return F.coalesce(F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s")), F.lit(""))


def year_or(year: Column, release_date: Column) -> Column:
    """The year, else the date's first four digits, else 0."""
    return F.coalesce(F.nullif(year.cast("int"), F.lit(0)), F.when(release_date.rlike("^[0-9]{4}"), F.substring(release_date, 1, 4).cast("int")), F.lit(0))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def item_key(title: Column, year: Column, id_: Column | None = None, given: Column | None = None, release_date: Column | None = None) -> Column:
    """given id unless it is empty, else title and year (or the release date's), else the row's id, else the empty title."""
    norm = title_key(title)
    known = F.coalesce(year.cast("int"), F.lit(0)) if release_date is None else year_or(year, release_date)
    y = F.when(known != 0, known.cast("string")).otherwise("")
    given = None if given is None else F.nullif(given.cast("string"), F.lit(""))
    by_title = F.concat(F.lit("title:"), norm, F.lit("|year:"), y)
    out = F.when(norm != "", by_title)
    if given is not None:
        out = F.when(given.isNotNull(), F.concat(F.lit("movie_id:"), given.cast("string"))).when(norm != "", by_title)
    if id_ is not None:
        out = out.when(id_.isNotNull(), F.concat(F.lit("id:"), id_.cast("string")))
    return out.otherwise("title:|year:")


def clip(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def whole_phrase(text: Column, phrases) -> Column:
    """True where any phrase stands in the text, not inside a longer word."""
    body = "|".join(sorted((p.replace("\\", "\\\\") for p in phrases), key=lambda p: (-len(p), p)))
    return text.rlike(f"(^|[^a-z0-9])({body})([^a-z0-9]|$)")


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from a hash of the key: the same on every engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def utc_stamp(moment: Column) -> Column:
    """A time as ISO-8601 in UTC to the second, ending in Z, whatever the session's time zone."""
    seconds = F.unix_seconds(moment.cast("timestamp"))
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
