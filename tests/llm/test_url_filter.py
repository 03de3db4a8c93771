"""Host, path, rules and reputation against plain Python."""

import math
import re

import pytest

from kiln.llm.queries import URL_RULES
from kiln.llm.url_filter import judge, reputation

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/A?x=/en/", "https://example.com/en/", "https://sub.example.com/en/1#t",
        "https://notexample.com/en/", "ftp://a.net/es/x", "ftp://a.net/fr/", "ftp://a.net/de/", "x://net/es/", "x://com", "x://com/", "x://É.COM/é://y",
        "a://b://c.com/", "http://h\nx.net/fr/\nz", "http://example.com?/en/", "http://www.example.com/en", "http://www.example.com/en/" + "p" * 20000]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u, "x", "x") for k, u in enumerate(URLS)] + [(None, URLS[4], "x", "x"), (5, URLS[5], "x", "x")],
                                  "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "host string, bad int")
    got = judge(pages, none, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = plain(URLS[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert judge(pages.limit(0), none, URL_RULES).collect() == []


def moments(rows):
    n, bad = sum(r[1] for r in rows), sum(r[0] for r in rows)
    p, k = bad / n, len(rows) - 1
    spread = sum(b * b / m for b, m in rows) - bad * bad / n
    below = n - sum(m * m for _, m in rows) / n - k
    rho = (spread / (p * (1 - p)) - k) / below if p * (1 - p) and below else 0.01
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def test_shrinkage(spark):
    counts = {"a.x.com": (9, 10), "b.x.com": (0, 0), "c.y.com": (1, 40), "d.y.com": (2, 3), "e.z.net": (5, 50), "f.z.net": (1, 1), "g.w.net": (30, 31)}
    rows = [(h, int(i < b)) for h, (b, n) in counts.items() for i in range(n)] + [(h, None) for h in counts]
    got = {r.host: r for r in reputation(spark.createDataFrame(rows, "host string, bad int"), z=2.0).collect()}

    def grouped(key):
        out = {}
        for h, (b, n) in counts.items():
            x = out.setdefault(key(h), [0, 0])
            x[0] += b
            x[1] += n
        return out

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    hosts, domains, suffixes = (({k: v for k, v in grouped(f).items()}) for f in (lambda h: h, domain, suffix))
    k_s, k_d, k_h = (moments([v for v in t.values() if v[1]]) for t in (suffixes, domains, hosts))
    overall = (sum(b for b, _ in counts.values()) + 1) / (sum(n for _, n in counts.values()) + 2)
    for h, (b, n) in counts.items():
        s = (suffixes[suffix(h)][0] + k_s * overall) / (suffixes[suffix(h)][1] + k_s)
        d = (domains[domain(h)][0] + k_d * s) / (domains[domain(h)][1] + k_d)
        x, y = b + k_h * d, n - b + k_h * (1 - d)
        sd = math.sqrt(x * y / ((x + y) ** 2 * (x + y + 1)))
        assert got[h].bad_rate == pytest.approx(x / (x + y)) and got[h].bad_low == pytest.approx(max(0, x / (x + y) - 2 * sd))
    assert got["b.x.com"].bad_rate > got["c.y.com"].bad_rate  # no outcomes: like its domain


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 20}.org/p") for k in range(400)], "page_id long, url string")
    out = spark.createDataFrame([(f"h{k % 20}.org", int(k % 20 < 3 or k % 37 == 0)) for k in range(2000)], "host string, bad int")
    got = judge(pages, out, [("allow", "h0.org", "/")]).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"h1.org", "h2.org"}
    assert all(r.bad_low <= r.bad_rate <= r.bad_high and r.n_outcomes == 100 for r in got)


def test_rules_of_any_number(spark):
    """A table of rules, and a list beyond what an expression holds, judge like the plain loop."""
    import random

    rng = random.Random(3)
    name = lambda k: ".".join(rng.choice(["a", "b", "com", "net", "x1"]) for _ in range(rng.randint(1, k)))
    start = lambda k: "/" + "/".join(rng.choice(["p", "q", "pq", "é"]) for _ in range(rng.randint(0, k)))
    rules = sorted({(rng.choice(["allow", "block"]), name(3), start(2)) for _ in range(3000)})
    assert len(rules) > 400
    urls = [f"http://{name(5)}{start(4)}" for _ in range(300)] + [None, "", "x://", "x://a", "x://" + "a." * 3000 + "com/p", *URLS]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    padded = rules + [("block", f"never{k}.org", "/") for k in range(1000)]

    def fits(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        found = [(len(h + p), v, h, p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(found)[2] + max(found)[3], max(found)[1]) if found else (None, "allow")

    want = {k: fits(u) for k, u in enumerate(urls)}
    for given in (spark.createDataFrame(padded, "verdict string, host string, path string"), padded):
        assert {r.page_id: (r.rule, r.verdict) for r in judge(pages, none, given).collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 100
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.rule for r in judge(pages, none, empty).collect()} == {None}


def test_suffix_table(spark):
    from kiln.llm.url_filter import with_suffix

    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.com", "y.x.com", "q.unknown", "", "z")], "host string")
    table = spark.createDataFrame([("uk",), ("co.uk",), ("com",), (None,), ("com",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in with_suffix(hosts, 1, table).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"),
                   "y.x.com": ("com", "x.com"), "q.unknown": ("unknown", "q.unknown"), "": ("", ""), "z": ("z", "z")}
    rates = {r.host: r.domain for r in reputation(hosts.withColumn("bad", __import__("pyspark").sql.functions.lit(1)), suffixes=table).collect()}
    assert rates["a.b.co.uk"] == "b.co.uk" and len(rates) == 8


def test_pages_and_labels_are_read_sparingly(spark):
    """The pages for their outcomes and for the result, the labels once."""
    from conftest import SF

    from kiln.llm import queries, url_filter

    plans = []
    kept = url_filter.stored
    url_filter.stored = lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, label)
    try:
        out = queries.QUERIES["op4_url_filters"](spark, SF)
    finally:
        url_filter.stored = kept
    whole = "".join(plans) + out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[page_id#", whole)) <= 2 and len(re.findall(r"Relation \[doc_id#", whole)) == 1, whole
