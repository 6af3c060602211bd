"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a pattern over lower-cased host + path: ``||`` binds it to a host or any of its subdomains, ``*`` stands for
any run of characters, all else is literal. Its tokens are the runs of letters and digits that the pattern closes on both
sides; the token that the fewest distinct URLs hold (counted over all of them) indexes the rule. URLs are split into
tokens, tokens fetch candidate rules, and only these run as regular expressions. Rules without a closed token are
candidates for every URL.

Among matching host rules the longest decides; failing these a URL is blocked if a pattern matches it, unless an exception
(a pattern behind ``@@``) does. ``read_patterns`` loads a list of any length, which is indexed like the built-in one.
Defined cases: a null url and one without ``://`` have empty host and path and match nothing; repeated URLs are judged
once; ties in length go to the larger text; empty tables, and an empty list of rules, give their rows verdict allow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import store

#: Host rules of the contract.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's own patterns; what they match is blocked where no host rule fits.
PATTERNS = ("||spam-farm.", "/adserver/", "/casino/", "/porn/", "||clickbait.*/free/")
#: Rules that are broadcast; beyond it candidates are fetched by a shuffle join.
BROADCAST_RULES = 100_000


def pattern_regex(pattern: str) -> str:
    """Java regular expression of a pattern, to be found in host + path."""
    bound, body = pattern.startswith("||"), pattern.removeprefix("||")
    quote = lambda s: re.sub(r"([^A-Za-z0-9/_])", r"\\\1", s)
    return (r"^(?:[^/]*\.)?" if bound else "") + "(?s:.*)".join(quote(p) for p in body.split("*"))


def _regex(pattern: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\|\|", ""), r"([^A-Za-z0-9/_*])", r"\\$1")
    return F.concat(F.when(pattern.startswith("||"), r"^(?:[^/]*\.)?").otherwise(""), F.replace(body, F.lit("*"), F.lit("(?s:.*)")))


def _tokens(pattern: Column) -> Column:
    """Literal tokens that any URL the pattern matches holds whole: runs closed on both sides by the pattern itself."""
    found = F.regexp_extract_all(F.regexp_replace(pattern, r"^\|\|", "^"), F.lit(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) of a text file of one pattern a line; blank lines and those that begin with ``!`` or ``#`` are comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("pattern")).filter((line != "") & ~line.rlike("^[!#]")).distinct()


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(rule, action, own, regex, tokens): own marks host rules. ``patterns``: texts, or a DataFrame (pattern)."""
    one = spark.range(1)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"), F.lit(True).alias("own"), F.lit("||" + r).alias("pattern")) for r, a in [*host_rules, ("", "")]])))
    if not isinstance(patterns, DataFrame):
        patterns = one.select(F.explode(F.array(*[F.lit(x) for x in [*patterns, ""]])).alias("pattern"))
    allow = F.col("pattern").startswith("@@")
    more = patterns.select(
        F.col("pattern").alias("rule"), F.when(allow, "allow").otherwise("block").alias("action"), F.lit(False).alias("own"), F.regexp_replace("pattern", "^@@", "").alias("pattern")
    )
    rows = rows.unionByName(more).filter("rule <> ''")
    return rows.select("rule", "action", "own", _regex(F.col("pattern")).alias("regex"), _tokens(F.col("pattern")).alias("tokens"))


def judge(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    p = store.columns(pages, "page_id", "url")
    rules = rule_table(p.sparkSession, host_rules, patterns)
    n_rules = rules.count() if isinstance(patterns, DataFrame) else len(host_rules) + len(patterns)
    near = lambda df: F.broadcast(df) if n_rules <= BROADCAST_RULES else df

    canon = F.concat(host(F.col("url")), path(F.col("url")))
    found = F.array_distinct(F.array_append(F.regexp_extract_all(F.lower("canon"), F.lit("[a-z0-9]+"), F.lit(0)), F.lit("")))
    usable = F.coalesce(F.col("url").contains("://"), F.lit(False))
    urls = p.filter(usable).select("url").distinct().withColumn("canon", canon)
    held = urls.select("url", "canon", F.explode(found).alias("token"))

    wanted = rules.select("rule", "own", F.explode("tokens").alias("token"))
    counts = held.join(near(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        wanted.join(near(counts), "token", "left")
        .groupBy("rule", "own")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).getField("token").alias("token"))
    )
    index = rules.join(near(rarest), ["rule", "own"], "left").select("rule", "action", "own", "regex", F.coalesce("token", F.lit("")).alias("token"))

    hits = held.join(near(index), "token").filter(F.expr("canon rlike regex"))
    best = F.max(F.when(F.col("own"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action")))).alias("best")
    decided = hits.groupBy("url").agg(best, F.min(F.when(~F.col("own"), F.col("action"))).alias("other"))
    # URLs without a host meet no rule, and no join key
    none = p.filter(~usable).select("url", "page_id", *[F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in ("best", "other")])
    out = p.filter(usable).join(decided, "url", "left").select(*none.columns).unionByName(none)
    return out.select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", "other", F.lit("allow")).alias("verdict"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``judge`` with the default rules, by testing every rule on every URL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    own = ", ".join(f"({text(r)}, {text(a)}, {text(r.split('/')[0])}, {text('/' + r.split('/', 1)[1])})" for r, a in HOST_RULES)
    other = " or ".join(f"regexp_matches(host || path, {text(pattern_regex(x))})" for x in PATTERNS)
    return f"""
    with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') as host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    r(rule, action, h, b) as (values {own}),
    m as (select host, path, rule, action, row_number() over (partition by host, path order by length(rule) desc, rule desc) as n
          from (select distinct host, path from p) u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.b))
    select p.page_id, p.host, p.path, m.rule, coalesce(m.action, case when {other} then 'block' else 'allow' end) as verdict
    from p left join m on m.host = p.host and m.path = p.path and m.n = 1
    """.replace("when regexp_matches(host || path", "when regexp_matches(p.host || p.path").replace("or regexp_matches(host || path", "or regexp_matches(p.host || p.path")
