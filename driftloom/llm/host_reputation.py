"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts for the urls that no rule decides.

Labelled pages give each host a count of good pages out of n. A host's rate is shrunk towards its registered domain's, the
domain's towards its suffix's, and the suffix's towards the rate of all pages: at each level the children of all parents
give a beta prior's strength by the method of moments (between-child variance against binomial variance), and a child's
posterior is Beta(strength * parent's mean + good, strength * (1 - parent's mean) + bad). A url is blocked when the upper
bound mean + z * sd of the posterior at its most specific labelled level is below least_good.

Only DataFrame functions are used. Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from
there up to "?", "#" or the end. A null url or one without "://" has an empty host and path and gets the prior of all pages.
Registered domain: the last two labels of the host without its port (three after a suffix such as co.uk; a numeric address
is its own domain); suffix: what follows the domain's first label. Without labels all means are 0.5 and nothing is blocked.
Every input row gives one result row; repeated and null page_ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path, verdict); of the rules that fit, the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Second-level names under which country registries hand out domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z = 2.0
LEAST_GOOD = 0.5
#: Bounds of the between-child correlation that a prior's strength is taken from.
LEAST_RHO, MOST_RHO = 0.001, 0.9
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    deep = F.lit(r"(^|\.)(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$")
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(F.regexp_like(bare, deep), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$"), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    table = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _shrunk(children: DataFrame, level: str, parents: DataFrame, parent: str | None) -> DataFrame:
    """Posterior of each child: level's key, alpha, beta, mean. children: keys, good, n; parent: the key that leads to its prior."""
    if parent:
        rows = children.join(parents.select(parent, F.col("mean").alias("prior")), parent, "left")
    else:
        rows = children.withColumn("prior", parents.select("mean").scalar())
    m, n, good = F.col("prior"), F.col("n").cast("double"), F.col("good").cast("double")
    # E[(good - n m)^2] = n m (1 - m) (1 + (n - 1) rho), and the prior's strength is 1 / rho - 1
    spare = F.sum(F.pow(good - n * m, 2) - n * m * (1 - m))
    room = F.sum(n * (n - 1) * m * (1 - m))
    rho = F.least(F.greatest(F.coalesce(F.when(room > 0, spare / room), F.lit(LEAST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    rows = rows.withColumn("strength", rows.agg(1 / rho - 1).scalar())
    rows = rows.withColumns({"alpha": F.col("strength") * m + good, "beta": F.col("strength") * (1 - m) + n - good})
    return rows.select(level, "alpha", "beta", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"))


def reputations(outcomes: DataFrame) -> dict[str, DataFrame]:
    """outcomes: url, good (0 or 1). Tables all, suffix, domain and host with alpha, beta and mean."""
    hosts = outcomes.where(F.col("good").isNotNull()).select(host_of(F.col("url")).alias("host"), F.col("good").cast("long").alias("good"))
    hosts = hosts.groupBy("host").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    total = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    good, n = F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    found = {"all": suffixes.agg((good + 0.5).alias("alpha"), (n - good + 0.5).alias("beta")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))}
    found["suffix"] = _shrunk(suffixes, "suffix", found["all"], None)
    found["domain"] = _shrunk(domains, "domain", found["suffix"], "suffix")
    found["host"] = _shrunk(hosts, "host", found["domain"], "domain")
    return found


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict, level, mean, bound. The rule's verdict wins over the reputation's."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = rows.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    found = reputations(outcomes)
    for level in ("host", "domain", "suffix"):
        hosts = hosts.join(found[level].select(level, F.struct("alpha", "beta").alias(f"at_{level}")), level, "left")
    hosts = hosts.withColumn("at_all", found["all"].select(F.struct("alpha", "beta")).scalar())
    best = F.coalesce("at_host", "at_domain", "at_suffix", "at_all")
    level = F.when(F.col("at_host").isNotNull(), "host").when(F.col("at_domain").isNotNull(), "domain").when(F.col("at_suffix").isNotNull(), "suffix").otherwise("all")
    a, b = F.col("best.alpha"), F.col("best.beta")
    hosts = hosts.select("host", level.alias("level"), best.alias("best")).withColumn("mean", a / (a + b))
    hosts = hosts.withColumn("bound", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (a + b + 1))).drop("best")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bound") < least_good, "block").otherwise("allow"))
    return rows.join(hosts, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "level", "mean", "bound")
