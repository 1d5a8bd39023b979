"""Operator 3: URL filters indexed by their rarest literal token.

A rule is a pattern over host and path, from which its regular expression and its literal tokens - whole runs of
letters, digits, ``_``, ``%`` and ``-`` that any fitting URL must hold - are derived. The operator counts
tokens over all URLs, files each rule under its rarest token, joins URL tokens to that index and
runs a rule's expression only on the URLs that hold its token. A rule without such a token is filed under a token that
every URL has, so it is tried on all.

Of fitting rules with a rank (contract rules: the length of host and path) the highest wins,
then the smallest rule; without one any fitting pattern decides: block if one blocks, then the smallest name. Rules may share a name; each
counts. A pattern that is no regular expression is an error (``ValueError`` for rules in a list). A null URL or one without
``://`` has an empty host and path, fits no contract rule and is allowed unless a pattern fits the empty string. URLs of any length are judged whole. Repeated rows are judged one by
one, null ids too; other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: The (host, path) rules of the contract, path from its first slash.
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The method's own patterns (block only). ``||`` is the start of a host label, ``^`` a slash or the end, ``*`` any characters.
PATTERNS = ["||ads-track.", "||adserver.", "/ads/", "/banners/", "/login^"]
_TOKEN = "A-Za-z0-9_%-"
#: The token that every URL has.
ANY = "*"
#: Rules in an index that is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens of a pattern: runs that no character beside them in a URL can extend."""
    inner = pattern.removeprefix("||")
    begun = " " if inner != pattern else ANY
    return sorted(set(re.findall(rf"(?<![{_TOKEN}*])[{_TOKEN}]+(?![{_TOKEN}*])", f"{begun}{inner}{ANY}")))


def expression(pattern: str) -> str:
    """The pattern as a regular expression over host and path."""
    inner = pattern.removeprefix("||")
    body = "".join({"*": ".*", "^": "(/|$)"}.get(c) or re.escape(c) for c in inner)
    return (r"(?s)^([^/]*\.)?" if inner != pattern else "(?s)") + body


def rule(pattern: str, verdict: str = "block", name: str | None = None, rank: int = 0) -> dict:
    """A rule of ``judge``; rank 0 marks the method's patterns."""
    return {"rule": pattern if name is None else name, "verdict": verdict, "pattern": expression(pattern), "tokens": literal_tokens(pattern), "rank": rank}


def default_rules() -> list[dict]:
    firm = [rule(f"||{host}{path}", verdict, host + path, len(host + path)) for host, path, verdict in HOST_RULES]
    return firm + [rule(p) for p in PATTERNS]


def judge(pages: DataFrame, rules: list[dict] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns page_id, host, path, rule, verdict, pattern_rule.

    ``rules``: rows of rule, verdict, pattern (a regular expression), tokens, rank; ``rule`` makes one of a pattern.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = default_rules() if rules is None else rules
        for r in rules:
            try:
                re.compile(r["pattern"])
            except re.error as e:
                raise ValueError(f"the pattern of rule {r['rule']!r}: {e}") from e
        rules = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rules)), "array<struct<rule:string,verdict:string,pattern:string,tokens:array<string>,rank:int>>")))
    url = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    url = url.select("page_id", host.alias("host"), path.alias("path"))
    held = F.array_distinct(F.filter(F.split(F.concat_ws("/", "host", "path"), f"[^{_TOKEN}]+"), lambda x: x != ""))

    whole = ["rule", "verdict", "pattern", "rank"]
    tokens = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ANY)))
    literal = rules.select(*whole, F.explode(tokens).alias("token")).distinct()
    # Only tokens of rules are counted: the counts are as many as the rules' tokens.
    small = rules.count() <= BROADCAST_RULES
    at = F.broadcast if small else lambda x: x
    counts = url.select(F.explode(held).alias("token")).join(at(literal.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = cut(literal.join(counts, "token", "left").groupBy(*whole).agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("least")).select(
        *whole, F.col("least.token").alias("token")))

    # One row without a token stands for each page, so pages without candidates and repeated rows are kept.
    tokens = F.concat(F.array(F.lit(None).cast("string"), F.lit(ANY)), held)
    fetched = url.select("page_id", "host", "path", F.explode(tokens).alias("token")).join(at(index), "token", "left")
    fetched = fetched.where(F.col("token").isNull() | F.col("pattern").isNotNull())
    fits = F.col("pattern").isNotNull() & F.rlike(F.concat("host", "path"), F.col("pattern"))
    judged = fetched.select(
        "page_id", "host", "path", F.col("token").isNull().alias("page"),
        F.when(fits & (F.col("rank") > 0), F.struct((-F.col("rank")).alias("order"), "rule", "verdict")).alias("firm"),
        F.when(fits & (F.col("rank") == 0), F.struct((F.col("verdict") != "block").alias("order"), "rule", "verdict")).alias("loose"))
    pages_out = judged.groupBy("page_id", "host", "path").agg(F.count_if("page").alias("rows"), F.min("firm").alias("firm"), F.min("loose").alias("loose"))
    verdict = F.coalesce("firm.verdict", "loose.verdict", F.lit("allow"))
    return pages_out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "page_id", "host", "path", F.col("firm.rule").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("firm").isNull(), F.col("loose.rule")).alias("pattern_rule"))
