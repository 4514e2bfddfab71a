"""Operator 3, URL filters with empirical-Bayes host reputation. DataFrame and SQL functions only.

A url is judged by the longest rule that fits it, else by its host's reputation: the share of bad
outcomes among labelled pages, shrunk through beta-binomial priors from the corpus to the public
suffix, from there to the registered domain and from there to the host. Each level's prior strength
comes from the spread of its own units (method of moments). A host is blocked if the lower bound of the
beta posterior of its bad share, at a level of 0.95, is above the cutoff; that is, if the posterior puts
at most 0.05 below the cutoff.

Reputation goes by the name in a host: without user, port and a closing dot. Addresses are kept whole.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and the corpus
reputation; a path is only what the url holds (``http://a.net`` has none, so ``net/`` does not fit);
of equally long rules a blocking one wins; repeated rows are judged alike; without labelled pages
every host is allowed; null outcomes are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which domains are registered, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "gv", "ltd", "me", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Domains whose subdomains belong to different people.
HOSTING = (
    "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "herokuapp.com",
    "neocities.org", "netlify.app", "pages.dev", "readthedocs.io", "substack.com", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com",
)
#: The suffix under which addresses stand.
ADDRESS = "(address)"
#: Rules up to this number are one literal; more are joined by host suffix.
LITERAL_RULES = 256


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns."""
    after = F.when(F.instr(url, F.lit("://")) > 0, url.substr(F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_name(host: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", "")


def registered(name: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host name: its last two labels and its last one, or three
    and two where domains are registered or given away under the last two; an address is its own domain."""
    parts = F.split(name, r"\.")
    last = lambda n: F.substring_index(name, ".", -n)
    country = F.element_at(parts, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(parts, -1)) == 2)
    two = (F.size(parts) >= 3) & (country | last(2).isin(*HOSTING))
    address = name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, ADDRESS).when(two, last(2)).otherwise(last(1))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function, by Stirling's series eight places on."""
    y = x + 8.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y)
    return series - F.ln(x * (x + 1.0) * (x + 2.0) * (x + 3.0)) - F.ln((x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0))


#: Pages (a + b) up to which the distribution function is summed, and terms of the sum.
SUMMED, TERMS = 400.0, 400


def surely_above(a: Column, b: Column, cutoff: float, z: float = 1.645, tail: float = 0.05) -> Column:
    """Whether a beta(a, b) share has at most ``tail`` (normal quantile ``-z``) below ``cutoff`` (0.9 at most).

    The distribution function is summed as a series of positive terms; above 400 pages a cube-root normal
    approximation is exact enough. A mean below ``(1 - tail) * cutoff`` rules it out beforehand."""
    n = a + b
    term = lambda s, k: s.t * (n + k) / (a + 1.0 + k) * cutoff
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, lambda s, k: F.struct(term(s, k).alias("t"), (s.s + term(s, k)).alias("s")), lambda s: s.s)
    below = F.exp(a * math.log(cutoff) + b * math.log(1.0 - cutoff) - F.ln(a) - _log_gamma(a) - _log_gamma(b) + _log_gamma(n)) * total
    u, v = F.cbrt(b * cutoff), F.cbrt(a * (1.0 - cutoff))
    score = 3.0 * (u * (1.0 - 1.0 / (9.0 * b)) - v * (1.0 - 1.0 / (9.0 * a))) / F.sqrt(u * u / b + v * v / a)
    return F.when(a < (1.0 - tail) * cutoff * n, False).when(n <= SUMMED, below <= tail).otherwise(score <= -z)


def _fits(rule: Column, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.concat(F.lit("."), rule.host))) & F.startswith(path, rule.path)


def _best(rules: Column) -> Column:
    """The longest of an array of rules, block before allow."""
    ranked = F.transform(rules, lambda r: F.struct(F.length(F.concat(r.host, r.path)).alias("n"), (r.verdict == "block").alias("b"), F.concat(r.host, r.path).alias("rule"), r.verdict.alias("verdict")))
    return F.array_max(ranked)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) and ``best``, the rule that decides, or null.

    ``rules``: (host, path, ``allow`` or ``block``)."""
    host, path = F.col("host"), F.col("path")
    if not rules:
        return pages.withColumn("best", F.lit(None).cast("struct<n: int, b: boolean, rule: string, verdict: string>"))
    if len(rules) <= LITERAL_RULES:
        literal = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
        return pages.withColumn("best", _best(F.filter(literal, lambda r: _fits(r, host, path))))
    table = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    hosts = pages.select("host").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    found = hosts.withColumn("end", F.explode(ends)).join(table.withColumnRenamed("host", "end"), "end")
    found = found.groupBy("host").agg(F.collect_set(F.struct(F.col("end").alias("host"), "path", "verdict")).alias("rules"))
    return pages.join(found, "host", "left").withColumn("best", _best(F.filter("rules", lambda r: F.startswith(path, r.path)))).drop("rules")


#: From n, b (pages and bad pages of a unit) and m (its prior mean): the prior's strength in pages, 1 / rho - 1
#: with rho the intra-class correlation that the units' spread around their prior means shows.
STRENGTH = "1.0 / greatest(0.01, least(0.5, coalesce(sum((b - n * m) * (b - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1.0) * m * (1 - m)), 0), 0.5))) - 1.0"


def reputation(hosts: DataFrame, outcomes: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """``host, labelled, bad_share, bad_host`` for each row of ``hosts`` (host, domain, suffix), from
    ``outcomes`` (host, domain, suffix, bad: 0 or 1).

    Each level is summed from the one below and written; the driver sees one number a level."""
    sums = F.sum("n").alias("n"), F.sum("b").alias("b")
    h = materialize(outcomes.groupBy("host").agg(F.min("domain").alias("domain"), F.min("suffix").alias("suffix"), F.count("*").alias("n"), F.sum("bad").alias("b")), "hosts")
    d = materialize(h.groupBy("domain").agg(F.min("suffix").alias("suffix"), *sums), "domains")
    s = materialize(d.groupBy("suffix").agg(*sums), "suffixes")
    m = s.select(F.expr("(coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0)").cast("double")).first()[0]

    def shrunk(level: DataFrame, key: str) -> DataFrame:
        k = float(level.select(F.expr(STRENGTH).cast("double")).first()[0])
        return materialize(level.select(key, ((F.col("b") + k * F.col("m")) / (F.col("n") + k)).alias("post")), key)

    s1 = shrunk(s.withColumn("m", F.lit(m)), "suffix")
    d1 = shrunk(d.join(s1.withColumnRenamed("post", "m"), "suffix"), "domain")
    h0 = materialize(h.join(d1.withColumnRenamed("post", "m"), "domain").select("host", "n", "b", "m"), "host-priors")
    k = float(h0.select(F.expr(STRENGTH).cast("double")).first()[0])
    a = hosts.join(h0.select("host", "n", "b"), "host", "left").join(d1.withColumnRenamed("post", "md"), "domain", "left").join(s1.withColumnRenamed("post", "ms"), "suffix", "left")
    a = a.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("md", "ms", F.lit(m)).alias("m"))
    a = a.withColumns({"al": F.col("b") + k * F.col("m"), "be": F.col("n") - F.col("b") + k * (1 - F.col("m"))}).withColumn("all", F.col("al") + F.col("be"))
    return a.select("host", F.col("n").alias("labelled"), (F.col("al") / F.col("all")).alias("bad_share"), surely_above(F.col("al"), F.col("be"), cutoff).alias("bad_host"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", cutoff: float = 0.5) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``by_reputation`` (whether no rule fitted).

    ``outcomes``: ``url`` and ``bad`` (boolean) of labelled pages."""
    host, path = url_parts(F.col(url_col))
    p = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), host_name(host).alias("name"))
    domain, suffix = registered(F.col("host"))
    o = outcomes.where("bad is not null").select(host_name(url_parts(F.col("url"))[0]).alias("host"), F.col("bad").cast("int").alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    hosts = p.select(F.col("name").alias("host")).distinct().withColumns({"domain": domain, "suffix": suffix})
    bad_hosts = materialize(reputation(hosts, o, cutoff).where("bad_host").select(F.col("host").alias("name"), "bad_host"), "hosts")
    p = with_rule(p, rules).join(checked_broadcast(bad_hosts), "name", "left")
    own = F.when(F.col("bad_host"), "block").otherwise("allow")
    return p.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), F.col("best").isNull().alias("by_reputation"))
