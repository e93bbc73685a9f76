"""URL filter: pattern rules indexed by their rarest literal token; DataFrame and SQL functions only.

A rule is a regular expression over the URL's host and path with the literal tokens that every match must contain. Each rule is filed under the one of its tokens that fewest URLs have; a URL's distinct tokens fetch the rules filed under them, and only those run their regular expression. Rules without a literal token are fetched by every URL.
Of the fetched rules that match, the longest decides; then the one of the smaller text. A URL that no listed rule fits is judged by the pattern rules: blocked if one of them matches, else allowed.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; both are empty without `://` or for null.
Defined cases: a null or empty URL fits no rule and is allowed; repeated rows and page ids give a row each; an empty table gives no rows; other columns are not read. The rules are broadcast while they are few (their number is checked); more rules are joined by shuffle, salted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed rules of the report: (verdict, host, path).
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Pattern rules of the method, for URLs that no listed rule fits: (name, regular expression over host and path, literal tokens).
PATTERNS = (
    ("link-farm", r"(^|[.-])(spam|link)-farm([.-]|/|$)", ("farm",)),
    ("pills", r"(^|[.-])(cheap|buy|online)-pills([.-]|/|$)", ("pills",)),
    ("casino", r"(^|[.-])casino([.-]|/|$)", ("casino",)),
    ("poker", r"(^|[.-])poker([.-]|/|$)", ("poker",)),
    ("adult", r"(^|[.-])(xxx|porn)([.-]|/|$)", ()),
    ("tracker", r"/(ads|adserver|banner)/", ()),
)
MOST_BROADCAST = 100_000  # rules


def host(url: Column) -> Column:
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, A-Z lower-cased."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda t: t != ""))


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def rule_table(spark: SparkSession, listed=LISTED, patterns=PATTERNS) -> DataFrame:
    """(rule, verdict, weight, regex, literals): listed rules weigh their length, patterns weigh 0."""
    rows = [(h + p, v, len(h + p), rf"^([^/]*\.)?{_escaped(h)}{_escaped(p)}", [t for t in re.split(r"[^a-z0-9]+", h + p) if t]) for v, h, p in listed]
    rows += [(name, "block", 0, regex, list(literals)) for name, regex, literals in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, weight int, regex string, literals array<string>")


def index(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """The rules with `token`: the rarest of their literals, '' where they have none."""
    spread = rules.select("rule", "verdict", "weight", "regex", F.explode_outer("literals").alias("token"))
    rare = spread.join(token_counts, "token", "left").groupBy("rule", "verdict", "weight", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("t"))
    return rare.select("rule", "verdict", "weight", "regex", F.coalesce("t.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame | None = None, most_broadcast: int = MOST_BROADCAST, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that matched, where no listed rule fits) for every row."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("subject", F.concat("host", "path"))
    subjects = urls.select("subject").distinct().withColumn("tokens", tokens(F.col("subject")))  # repeated URLs are judged once
    few = rules.limit(most_broadcast + 1).count() <= most_broadcast
    literals = rules.select(F.explode("literals").alias("token")).distinct()
    held = subjects.select(F.explode("tokens").alias("token")).join(F.broadcast(literals) if few else literals, "token", "left_semi")
    filed = index(rules, held.groupBy("token").agg(F.count("*").alias("n")))
    fetched = subjects.select("subject", F.explode(F.array_union("tokens", F.array(F.lit("")))).alias("token"))
    if few:
        fetched = fetched.join(F.broadcast(filed), "token")
    else:
        fetched = fetched.withColumn("salt", F.pmod(F.xxhash64("subject"), F.lit(salts)).cast("int")).join(filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["token", "salt"])
    best = fetched.where("subject rlike regex").groupBy("subject").agg(F.min(F.struct((-F.col("weight")).alias("w"), "rule", "verdict")).alias("best"))
    listed = F.coalesce(F.col("best.w") < 0, F.lit(False))
    return urls.join(best, "subject", "left").select(
        "page_id", "host", "path", F.when(listed, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.when(~listed, F.col("best.rule")).alias("pattern")
    )


ORACLE = r"""
with u as (select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
listed(rule, h, p, v) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits as (select distinct host, path, rule, v from (select distinct host, path from u) s join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
one as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from fits group by host, path),
m as (select u.*, one.rule, one.v, case
    when one.rule is not null then null
    when regexp_matches(host || path, '(^|[.-])(xxx|porn)([.-]|/|$)') then 'adult'
    when regexp_matches(host || path, '(^|[.-])casino([.-]|/|$)') then 'casino'
    when regexp_matches(host || path, '(^|[.-])(spam|link)-farm([.-]|/|$)') then 'link-farm'
    when regexp_matches(host || path, '(^|[.-])(cheap|buy|online)-pills([.-]|/|$)') then 'pills'
    when regexp_matches(host || path, '(^|[.-])poker([.-]|/|$)') then 'poker'
    when regexp_matches(host || path, '/(ads|adserver|banner)/') then 'tracker' end as pattern
  from u left join one using (host, path))
select page_id, host, path, rule, coalesce(v, case when pattern is null then 'allow' else 'block' end) as verdict, pattern from m
"""
