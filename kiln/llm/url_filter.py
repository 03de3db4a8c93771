"""URL filters: rules first, else empirical-Bayes host reputation (operator 4, native).

Labelled page outcomes (1 bad, 0 good) are counted by host, once per host before anything is
shuffled further. Bad rates shrink down the name: the suffix's towards the overall rate, the
registered domain's towards its suffix's, the host's towards its domain's. How strongly a level
shrinks is a beta-binomial prior fitted to that level by the method of moments: with N outcomes
over K siblings, rates p_i and overall rate p,

    rho = (sum n_i (p_i - p)^2 / (p (1 - p)) - (K - 1)) / (N - sum n_i^2 / N - (K - 1)),

and a prior of ``1 / rho - 1`` pseudo-outcomes. A host's posterior is Beta(a, b); it is blocked
where the lower posterior bound ``mean - z sd`` of its bad rate exceeds ``max_bad``. A host
without outcomes has its domain's prior as posterior.

Suffixes are a fixed number of labels, or the longest that fits from a table of them (``co.uk``
beside ``com``); the registered domain is one label more.

Rules: (verdict, host, path); a rule fits its host and all subdomains where the url's path
starts with the rule's, the longest rule wins, and rules overrule the method. A list of up to
``LISTED_RULES`` is part of the expression, and the pages are not shuffled for it. Longer lists and
tables of rules are joined: on the last labels of each host (as many as rules have), then on the
start of the path at the lengths that rules of that host have.

Defined results: NULL urls and urls without ``://`` have an empty host and path, which is a host
like any other; pages without outcome only receive a verdict; an outcome that is NULL counts
for nothing; repeated pages stay and count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.shared import stored

LISTED_RULES = 1000
Rule = tuple[str, str, str]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, NULL without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def _tails(host: Column, most: int) -> Column:
    """The last 1 .. ``most`` labels of a host, array<struct(labels, tail)>."""
    n = F.least(F.lit(most), F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("labels"), last_labels(host, i).alias("tail")))


def _most_labels(names: DataFrame) -> int:
    return names.agg(F.max(F.size(F.split("name", "[.]")))).first()[0] or 0


def fitting_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) that a rule fits, by the longest.
    ``rules`` has verdict, host, path."""
    rules = rules.select(F.col("host").alias("name"), F.col("path").alias("start"), "verdict").where("name is not null and start is not null").distinct()
    most = _most_labels(rules)
    if not most:
        return pages.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).limit(0)
    lengths = rules.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))
    hosts = pages.select("host").distinct().withColumn("t", F.explode(_tails(F.col("host"), most))).select("host", F.col("t.tail").alias("name"))
    asked = hosts.join(lengths, "name").groupBy("host").agg(F.flatten(F.collect_list(F.transform("lengths", lambda n: F.struct("name", n.alias("n"))))).alias("asked"))
    starts = pages.select("host", "path").distinct().join(asked, "host").select(
        "host", "path", F.explode(F.filter("asked", lambda a: a["n"] <= F.length("path"))).alias("a"))
    starts = starts.select("host", "path", F.col("a.name").alias("name"), F.substr("path", F.lit(1), F.col("a.n")).alias("start"))
    longest = F.struct(F.length("name") + F.length("start"), "verdict", "name", "start")  # ties as in a list
    best = starts.join(rules, ["name", "start"]).groupBy("host", "path").agg(F.max_by(F.struct("name", "start", "verdict"), longest).alias("r"))
    return best.select("host", "path", F.concat("r.name", "r.start").alias("rule"), "r.verdict")


def with_suffix(hosts: DataFrame, labels: int, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row each, column host) with suffix and registered domain. ``suffixes`` (column
    suffix) names them; a host that none of them ends takes its last ``labels`` labels."""
    n = F.lit(labels)
    if suffixes is not None:
        names = suffixes.select(F.col("suffix").alias("name")).where("name is not null").distinct()
        most = _most_labels(names)
        if most:
            tails = hosts.select("host", F.explode(_tails(F.col("host"), most)).alias("t")).select("host", "t.labels", F.col("t.tail").alias("name"))
            found = tails.join(names, "name").groupBy("host").agg(F.max("labels").alias("own_labels"))
            hosts = hosts.join(found, "host", "left")
            n = F.coalesce("own_labels", n)
    return hosts.withColumns({"suffix": last_labels(F.col("host"), n), "domain": last_labels(F.col("host"), n + 1)}).drop("own_labels")


def _concentration() -> Column:
    """Pseudo-outcomes of a level's prior from its rows (bad, n), as an aggregate."""
    n, bad = F.sum("n"), F.sum("bad")
    p = bad / n
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / n  # sum of n_i (p_i - p)^2
    k = F.count(F.lit(1)) - 1
    rho = F.try_divide(F.try_divide(spread, p * (1 - p)) - k, n - F.try_divide(F.sum(F.col("n") * F.col("n")), n) - k)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(1e-3)), F.lit(0.5))
    return 1 / rho - 1


def reputation(outcomes: DataFrame, z: float = 1.645, suffix_labels: int = 1, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad), also where every ``bad`` is NULL: bad, n,
    the posterior's a and b, bad_rate (its mean), bad_low and bad_high (its bounds)."""
    counted = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    counted = stored(with_suffix(counted, suffix_labels, suffixes), "host-outcomes")  # the outcomes are read once
    domains = counted.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    levels = [df.select(F.lit(k).alias("level"), "bad", "n") for k, df in enumerate((suffixes, domains, counted))]
    fitted = {r["level"]: r for r in levels[0].union(levels[1]).union(levels[2]).where("n > 0").groupBy("level").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), _concentration().alias("strength")).collect()}  # three rows
    strength = [(fitted[k]["strength"] if k in fitted else None) or 1.0 for k in range(3)]
    overall = (fitted[0]["bad"] + 1) / (fitted[0]["n"] + 2) if 0 in fitted else 0.5
    up = suffixes.select("suffix", ((F.col("bad") + strength[0] * overall) / (F.col("n") + strength[0])).alias("above"))
    up = domains.join(up, "suffix").select("suffix", "domain", ((F.col("bad") + strength[1] * F.col("above")) / (F.col("n") + strength[1])).alias("above"))
    hosts = counted.join(up, ["suffix", "domain"]).withColumns({
        "a": F.col("bad") + strength[2] * F.col("above"), "b": F.col("n") - F.col("bad") + strength[2] * (1 - F.col("above"))})
    return _posterior(hosts, z)


def _posterior(hosts: DataFrame, z: float) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.withColumns({"bad_rate": mean, "bad_low": F.greatest(F.lit(0.0), mean - z * sd), "bad_high": F.least(F.lit(1.0), mean + z * sd)})


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule] | DataFrame, max_bad: float = 0.5, z: float = 1.645,
          suffix_labels: int = 1, suffixes: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """Per page (page_id, url): page_id, host, path, rule, verdict, and the host's reputation;
    ``outcomes`` are rows (host, bad). ``complete``: they name every host of ``pages``, with a NULL
    ``bad`` where nothing is known, so the pages need not be read for their hosts."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    outcomes = outcomes.select("host", F.col("bad").cast("int").alias("bad"))
    if not complete:
        outcomes = outcomes.union(rows.select("host", F.lit(None).cast("int").alias("bad")).distinct())
    known = reputation(outcomes, z, suffix_labels, suffixes).select("host", F.col("n").cast("long").alias("n_outcomes"), "bad_rate", "bad_low", "bad_high")
    judged = rows.join(known, "host", "left")
    if isinstance(rules, DataFrame) or len(rules) > LISTED_RULES:
        given = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        judged = judged.join(fitting_rules(rows, given), ["host", "path"], "left").withColumn("fit", F.struct("rule", "verdict"))
    else:
        judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
                         "n_outcomes", "bad_rate", "bad_low", "bad_high")
