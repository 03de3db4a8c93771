"""Secret scans: fixed patterns and a randomness test battery (operator 9, native).

Base spans come from three patterns (assignments to secret names, access keys, long hexadecimal
runs), leftmost and non-overlapping per kind. Positions count code points, ends exclusive; they
are read off the lengths of the matches and of the text between them, so a text is scanned by
the JVM's regular expressions only.

The battery adds spans of kind ``random``. Candidates are runs of 16 or more token characters
that hold a digit or both cases. Each gets an inferred encoding (hex, lower or upper base 32/36,
base 62, base 64) with alphabet size k, and over its n symbols

* chi-squared against uniform use of the alphabet,
* the runs test on symbols above and below the middle of the alphabet,
* the lag-1 serial correlation of the symbols' places;

a candidate is plausible as random if none of the three rejects at ``alpha`` / 3. That alone
would let short ordinary words pass, as the tests have little power there. So its p-value is
taken under the opposite hypothesis, ordinary text in that alphabet, whose chi-squared grows as
``n`` times a known excess; the shorter the token, the larger the p-value. Benjamini-Hochberg
over all candidates of the corpus, in strata of length, keeps the share of ordinary tokens among
the added spans below ``fdr``. The counts per stratum and p-value bin are the only thing that
crosses documents; the driver reads one threshold per stratum (at most 64).

Defined results: NULL text is empty; a document without spans has empty strings and zero
counts; a candidate inside a base span adds nothing; repeated rows are repeated results, and
count as often as they occur in the battery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import norm_cdf
from kiln.llm.shared import fresh, stored

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run is maximal, so asking for its length is the same as dropping short ones
HEX = "[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, alphabet in order, pattern, and excess of ordinary text: k * sum(q_c^2) - 1 for decimal
#: digits (hex) or letters by their usual frequencies.
ENCODINGS = [("hex", DIGITS + "abcdef", "^[0-9a-f]+$", 0.6), ("HEX", DIGITS + "ABCDEF", "^[0-9A-F]+$", 0.6),
             ("base36", DIGITS + LOWER, "^[0-9a-z]+$", 1.3), ("BASE36", DIGITS + UPPER, "^[0-9A-Z]+$", 1.3),
             ("base62", UPPER + LOWER + DIGITS, "^[0-9A-Za-z]+$", 2.6), ("base64", UPPER + LOWER + DIGITS + "+/", "", 2.7)]
#: Code points of a segment, at least. A segment ends before a character that no pattern has, or before
#: a blank that cannot belong to an assignment; text without such a place stays one segment.
SEGMENT = 8192
SEGMENTS = (f"(?s).{{{SEGMENT}}}.*?(?=[^A-Za-z0-9+/_.=\"' :-]|(?<![ :=]) [A-Za-z0-9]|\\z)|.+")
BINS_PER_DECADE = 10
MOST_BIN = 400


def segments(text: Column) -> Column:
    """The text in pieces that no match reaches across; what grows with matches stays inside one."""
    return F.when(F.length(text) <= SEGMENT, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(SEGMENTS), F.lit(0)))


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct(start, end, hit)>; those whose ``group``
    is shorter than ``least`` are dropped after they have taken their text."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))
    row = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), value.alias("value"))
    row = F.slice(row, F.lit(1), F.size(hits))  # the last gap has no match behind it
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        keep = F.length(x["value"]) >= least if least else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(row, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def battery(token: Column) -> Column:
    """struct(encoding, n, p_chi, p_runs, p_serial, p_text) of a token."""
    name, alphabet, excess = F.lit("base64"), F.lit(ENCODINGS[-1][1]), F.lit(ENCODINGS[-1][3])
    for code, letters, pattern, more in reversed(ENCODINGS[:-1]):
        name = F.when(token.rlike(pattern), code).otherwise(name)
        alphabet = F.when(token.rlike(pattern), letters).otherwise(alphabet)
        excess = F.when(token.rlike(pattern), F.lit(more)).otherwise(excess)
    plain = F.translate(token, "-_", "+/")

    def tests(v):
        tok, abc = v["token"], v["alphabet"]
        n, k = F.length(tok).cast("double"), F.length(abc).cast("double")
        squares = F.aggregate(F.transform(F.split(abc, ""), lambda c: n - F.length(F.replace(tok, c, F.lit("")))), F.lit(0.0), lambda a, x: a + x * x)
        place = F.transform(F.split(tok, ""), lambda c: F.instr(abc, c).cast("double"))
        return F.struct(v["name"].alias("name"), v["excess"].alias("excess"), n.alias("n"), k.alias("k"),
                        (k / n * squares - n).alias("chi"), place.alias("place"))

    def sums(v):
        place, n = v["place"], v["n"]
        high = F.transform(place, lambda x: F.when(x > v["k"] / 2, 1.0).otherwise(0.0))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
        ahead, behind = F.slice(place, F.lit(2), F.size(place) - 1), F.slice(place, F.lit(1), F.size(place) - 1)
        turns = F.zip_with(F.slice(high, F.lit(2), F.size(high) - 1), F.slice(high, F.lit(1), F.size(high) - 1), lambda a, b: F.abs(a - b))
        return F.struct(v["name"].alias("name"), v["excess"].alias("excess"), n.alias("n"), v["k"].alias("k"), v["chi"].alias("chi"),
                        total(high).alias("up"), (total(turns) + 1).alias("runs"), (total(place) / n).alias("mean"),
                        total(F.transform(place, lambda x: x * x)).alias("sq"), total(F.zip_with(ahead, behind, lambda a, b: a * b)).alias("lag"),
                        F.element_at(place, 1).alias("first"), F.element_at(place, -1).alias("last"))

    def p_values(v):
        n, k, mean = v["n"], v["k"], v["mean"]
        z_chi = (v["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        up, down = v["up"], n - v["up"]
        mu = 2 * up * down / n + 1
        z_runs = F.coalesce(F.try_divide(v["runs"] - mu, F.sqrt(F.greatest(F.try_divide((mu - 1) * (mu - 2), n - 1), F.lit(0.0)))), F.lit(-9.0))
        lag = v["lag"] - mean * (2 * n * mean - v["first"] - v["last"]) + (n - 1) * mean * mean
        z_serial = F.coalesce(F.try_divide(lag, v["sq"] - n * mean * mean), F.lit(1.0)) * F.sqrt(n)
        grown = n * v["excess"]
        z_text = (v["chi"] - (k - 1) - grown) / F.sqrt(2 * (k - 1 + 2 * grown))
        two = lambda z: 2 * norm_cdf(-F.abs(z))
        return F.struct(v["name"].alias("encoding"), n.cast("bigint").alias("n"), (1 - norm_cdf(z_chi)).alias("p_chi"), two(z_runs).alias("p_runs"),
                        two(z_serial).alias("p_serial"), norm_cdf(z_text).alias("p_text"))

    start = F.array(F.struct(plain.alias("token"), name.alias("name"), alphabet.alias("alphabet"), excess.alias("excess")))
    return F.transform(F.transform(F.transform(start, tests), sums), p_values)[0]


def _bare(c: Column) -> Column:
    return F.transform(c, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def raw_spans(text: Column) -> Column:
    """By segment: array<struct(n, assign, access, hex: array<struct(start, end)>, candidates:
    array<struct(start, end, test)>)>, places counted inside the segment of n code points."""
    return F.transform(segments(text), _raw)


def _raw(text: Column) -> Column:
    def free(v):
        mixed = F.filter(v["tokens"], lambda t: t["hit"].rlike("[0-9]") | (t["hit"].rlike("[a-z]") & t["hit"].rlike("[A-Z]")))
        base = F.concat(v["assign"], v["access"], v["hex"])
        left = F.filter(mixed, lambda t: ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
        tested = F.transform(left, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["hit"]).alias("test")))
        return F.struct(v["n"].alias("n"), _bare(v["assign"]).alias("assign"), _bare(v["access"]).alias("access"), _bare(v["hex"]).alias("hex"), tested.alias("candidates"))

    all_of = F.struct(F.length(text).cast("bigint").alias("n"), spans(text, ASSIGN, 1, ASSIGN_LEAST).alias("assign"), spans(text, ACCESS).alias("access"),
                      spans(text, HEX).alias("hex"), spans(text, CANDIDATE).alias("tokens"))
    return F.transform(F.array(all_of), free)[0]


def _stratum(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    """p-values in steps of a tenth of a decade; a higher bin is a smaller p-value."""
    return F.least(F.lit(MOST_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE)).cast("int")


def thresholds(found: DataFrame, fdr: float, alpha: float) -> dict[int, int]:
    """For each stratum of length, the least bin that Benjamini-Hochberg accepts."""
    tests = found.select(F.explode(F.flatten("raw.candidates")).alias("c")).select(F.col("c.test").alias("t")).select(_stratum(F.col("t.n")).alias("stratum"), _plausible(F.col("t"), alpha).alias("ok"), _bin(F.col("t.p_text")).alias("bin"))
    counts = tests.groupBy("stratum", F.when(F.col("ok"), F.col("bin")).otherwise(F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stratum")  # at most MOST_BIN + 2 rows each
    ranked = counts.withColumn("rank", F.sum("n").over(order.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(order))
    upper = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)  # no p-value of the bin is larger
    passed = ranked.where((F.col("bin") >= 0) & (upper <= fdr * F.col("rank") / F.col("m")))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def _plausible(t: Column, alpha: float) -> Column:
    return (t["p_chi"] >= alpha / 3) & (t["p_runs"] >= alpha / 3) & (t["p_serial"] >= alpha / 3)


def _accepted(raw: Column, least: dict[int, int], alpha: float, offset: Column) -> Column:
    """array<struct(start, kind_no, end, kind)> of a segment's spans that stay, by start, then kind."""
    def random(t):
        out = F.lit(False)
        for stratum, b in least.items():
            out = out | ((_stratum(t["test"]["n"]) == stratum) & (_bin(t["test"]["p_text"]) >= b))
        return out & _plausible(t["test"], alpha)

    def kind(c, no):
        return F.transform(c, lambda t: F.struct((t["start"] + offset).alias("start"), F.lit(no).alias("kind_no"), (t["end"] + offset).alias("end"), F.lit(KINDS[no]).alias("kind")))

    return F.array_sort(F.concat(kind(raw["assign"], 0), kind(raw["access"], 1), kind(raw["hex"], 2), kind(F.filter(raw["candidates"], random), 3)))


def accepted(raw: Column, least: dict[int, int], alpha: float) -> Column:
    """The spans of a text that stay, by start, then kind, from those of its segments."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("offsets"))
    offsets = F.aggregate(raw, start, lambda acc, r: F.struct((acc["at"] + r["n"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets")),
                          lambda acc: acc["offsets"])
    return F.flatten(F.zip_with(raw, offsets, lambda r, offset: _accepted(r, least, alpha, offset)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, alpha: float = 0.001) -> DataFrame:
    """Per row: doc_id and ``found``, array<struct(start, kind_no, end, kind)> by start, then kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), raw_spans(text).alias("raw")), "secret-spans")
    return rows.select("doc_id", accepted(F.col("raw"), thresholds(rows, fdr, alpha), alpha).alias("found"))


def redacted(docs: DataFrame, text_col: str = "text", fdr: float = 0.01, alpha: float = 0.001, mark: str = "[secret]") -> DataFrame:
    """``docs`` with its secrets cut out of the text. The patterns and the battery run once: the rows
    are stored with their spans, and cut when the thresholds are known."""
    text, name = F.col(f"`{text_col}`"), fresh(docs, "raw")
    rows = stored(docs.withColumn(name, raw_spans(F.coalesce(text, F.lit("")))), "secret-rows")
    least = thresholds(rows.select(F.col(name).alias("raw")), fdr, alpha)
    cut = F.array_join(F.zip_with(segments(text), F.col(name), lambda s, r: redact(s, _accepted(r, least, alpha, F.lit(0)), mark)), "")
    any_span = F.size(accepted(F.col(name), least, alpha)) > 0
    return rows.withColumn(text_col, F.when(any_span, cut).otherwise(text)).drop(name)


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``. Work grows with spans
    times length: for a segment, or a short text."""
    def cut(text: Column, found: Column) -> Column:
        def step(acc, t):
            inside = t["start"] < acc["at"]
            return F.struct(F.greatest(acc["at"], t["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (t["start"] - acc["at"]).cast("int"))))).alias("out"))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(found, start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substr(text, (a["at"] + 1).cast("int")))), mark))

    worked = F.transform(F.array(F.struct(text.alias("text"), found.alias("found"))), lambda v: F.when(F.size(v["found"]) > 0, cut(v["text"], v["found"])).otherwise(v["text"]))
    return worked[0]
