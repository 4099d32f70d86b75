"""URL verdicts from pattern rules indexed by their rarest literal token.

Rules come in two kinds.  A *site rule* names a host (with its subdomains) and
a path prefix; the longest that fits a URL decides.  A *pattern* is a literal
in which ``*`` stands for any run; it blocks a URL that contains it and that no
site rule decides.

A *token* is a maximal run of ASCII letters and digits.  Tokens that any URL of
a rule must hold whole are read off the rule; the one that the fewest URLs of
the table hold becomes its index key.  URL tokens fetch the candidate rules by a
join, and only those run a regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str  # site rule: host/path; pattern: the literal
    verdict: str
    site: bool

    def regex(self) -> str:
        if not self.site:
            return ".*".join(map(re.escape, self.text.lower().split("*")))
        host, _, path = self.text.partition("/")
        return rf"^(?:[^\x00]*\.)?{re.escape(host.lower())}\x00{re.escape('/' + path)}"

    def tokens(self) -> list[str]:
        """Runs of letters and digits with another character (not a wildcard) on both sides."""
        text = f".{self.text.lower()}" if self.site else self.text.lower()
        return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)))


# Fixed rules: the site rules of the contract, and the patterns that this filter adds.
SITES = (Rule("net/", "block", True), Rule("example.net/en/", "allow", True), Rule("example.com/de/", "block", True), Rule("org/fr/", "allow", True))
PATTERNS = tuple(Rule(p, "block", False) for p in (
    "/spam-farm.", ".spam-farm.", "/cheap-pills.", ".cheap-pills.", "/casino-", "-casino.", "/casino/", "/poker/", "/adult/", "/xxx/",
    "/wp-login.php", "/cgi-bin/", "/doorway/", "/free-download/", "?affid=", "&affid=", "?clickid=", "&clickid=", "://*.bit.ly/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def rarest_tokens(tokens: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(no, token): each rule's least frequent literal token in (url, token)."""
    bare = [r.text for r in rules if not r.tokens()]
    if bare:
        raise ValueError(f"rules without a literal token cannot be indexed: {bare}")
    spark = tokens.sparkSession
    literal = spark.createDataFrame([(k, t) for k, r in enumerate(rules) for t in r.tokens()], "no int, token string")
    seen = tokens.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    best = Window.partitionBy("no").orderBy(F.coalesce("seen", F.lit(0)), "token")
    return literal.join(seen, "token", "left").withColumn("r", F.row_number().over(best)).where("r = 1").select("no", "token")


def judge(pages: DataFrame, sites: tuple[Rule, ...] = SITES, patterns: tuple[Rule, ...] = PATTERNS, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule`` (site rule or
    null), ``pattern`` (the first pattern in the rules' order that blocks, or
    null), ``verdict``.

    Each distinct URL is judged once.  Null URLs, and URLs without ``://``, have
    an empty host and path; a null URL is allowed.  Columns of ``pages`` with
    the names of the new ones are replaced.
    """
    rules = (*sites, *patterns)
    spark = pages.sparkSession
    urls = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    tokens = urls.select("url", F.explode(F.array_distinct(F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+"))).alias("token")).where("token <> ''")
    table = spark.createDataFrame([(k, r.text, r.verdict, r.site, r.regex()) for k, r in enumerate(rules)],
                                  "no int, text string, verdict string, site boolean, regex string")
    index = table.join(rarest_tokens(tokens, rules), "no")
    subject = F.when(F.col("site"), F.concat(host_of(F.col("url")), F.lit("\0"), path_of(F.col("url")))).otherwise(F.translate("url", UPPER, LOWER))
    fits = tokens.join(index, "token").where(F.rlike(subject, F.col("regex")))
    longest = F.max_by(F.struct("text", "verdict"), F.when(F.col("site"), F.struct(F.char_length("text"), -F.col("no"))))
    first = F.min_by("text", F.when(~F.col("site"), F.col("no")))
    judged = fits.groupBy("url").agg(longest.alias("best"), first.alias("pattern"), F.max("site").alias("by_site"))
    judged = judged.select(F.col("url").alias("_url"), F.when(F.col("by_site"), F.col("best.text")).alias("_rule"), F.col("pattern").alias("_pattern"),
                           F.when(F.col("by_site"), F.col("best.verdict")).when(F.col("pattern").isNotNull(), "block").alias("_verdict"))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    return (pages.withColumn("_key", F.col(url_col)).join(judged, F.col("_key") == F.col("_url"), "left")
            .withColumns({"host": host, "path": path, "rule": F.col("_rule"), "pattern": F.when(F.col("_rule").isNull(), F.col("_pattern")),
                          "verdict": F.coalesce("_verdict", F.lit("allow"))})
            .drop("_key", "_url", "_rule", "_pattern", "_verdict"))
