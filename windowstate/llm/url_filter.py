"""URL filter: rules indexed by their rarest literal token.

Every rule names the literal tokens any URL it fits must hold. Token frequencies over all URLs choose the rarest
token of each rule as its index entry; the tokens of a URL fetch the rules filed under them, and only those
fetched rules run their regular expression. All of it is DataFrame operations.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; an empty
table gives an empty result; repeated pages each get their row; other columns of `pages` are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowstate.llm.common import ascii_lower, rows_of

TOKEN_BREAK = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`regex` is tried on host + path. `tokens` are whole tokens of every URL that fits. Host rules come before
    patterns, longer rules before shorter ones, then the smaller name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def host_rule(name: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the path starts with the rule's path. A path that does
    not end in a token break may cut its last token, which is then not indexed."""
    host, slash, path = name.partition("/")
    whole = (host + slash + re.sub(r"[a-z0-9]+$", "", path.lower())).lower()
    tokens = tuple(sorted({t for t in re.split(TOKEN_BREAK, whole) if t}))
    return Rule(name, verdict, rf"^([^/]*\.)?{re.escape(name)}", tokens, host_rule=True)


def pattern_rule(name: str, verdict: str, regex: str, *tokens: str) -> Rule:
    return Rule(name, verdict, regex, tokens)


# The contract's rules (fixed values).
BASE_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
              host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
# The method's own patterns, for URLs that no host rule fits.
PATTERN_RULES = [
    pattern_rule("cheap-pills", "block", r"^[^/]*(^|[.-])cheap-pills([.-]|$|/)", "cheap", "pills"),
    pattern_rule("casino", "block", r"^[^/]*(^|[.-])casino([.-]|$|/)", "casino"),
    pattern_rule("free-money", "block", r"(^|[./-])free-money([./-]|$)", "free", "money"),
    pattern_rule("wp-login", "block", r"/wp-login\.php$", "wp", "login", "php"),
    pattern_rule("win-prize", "block", r"[./-]win-(a-)?prize([./-]|$)", "win", "prize"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of the contract."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit("")))


def rarest_tokens(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, token): for each rule its literal token with the fewest URLs, ties to the smaller token."""
    spark = tokens.sparkSession
    filed = rows_of(spark, ["rule_id", "token"], [(i, t) for i, r in enumerate(rules) for t in r.tokens])
    seen = (tokens.join(F.broadcast(filed.select("token").distinct()), "token")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return (filed.join(seen, "token", "left").groupBy("rule_id")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
            .select("rule_id", F.col("m.token").alias("token")))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): `rule` is the host rule that decided, `pattern` the method's
    pattern that decided where no host rule did; without either the page is allowed. The rule list is code, so its
    tables are small by construction and are broadcast."""
    rules = BASE_RULES + PATTERN_RULES if rules is None else rules
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = (pages.select("url").where(F.col("url").isNotNull()).distinct()
            .select("url", F.concat(host, path).alias("subject")))
    tokens = urls.select("url", "subject", F.explode(F.array_distinct(F.filter(
        F.split(ascii_lower(F.col("subject")), TOKEN_BREAK), lambda t: t != ""))).alias("token"))
    index = rarest_tokens(tokens, rules)
    told = rows_of(spark, ["rule_id", "name", "rule_verdict", "regex", "host_rule"],
                   [(i, r.name, r.verdict, r.regex, r.host_rule) for i, r in enumerate(rules)])
    best = F.max_by(F.struct("name", "rule_verdict", "host_rule"),
                    F.struct("host_rule", F.length("name"), -F.col("rule_id")))
    decided = (tokens.join(F.broadcast(index.join(F.broadcast(told), "rule_id")), "token")
               .where(F.expr("subject rlike regex"))
               .groupBy("url").agg(best.alias("best")))
    by_host = F.col("best.host_rule")
    return (pages.select("page_id", "url").join(decided, "url", "left")
            .select("page_id", host.alias("host"), path.alias("path"),
                    F.when(by_host, F.col("best.name")).alias("rule"),
                    F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"),
                    F.when(~by_host, F.col("best.name")).alias("pattern")))
