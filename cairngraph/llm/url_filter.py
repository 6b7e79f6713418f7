"""URL filters: fixed rules, then empirical-Bayes host reputation.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. Any other
url is judged by its host: labelled outcomes of pages (bad or not) are counted by host, registered
domain and suffix, and each level's posterior mean is the prior mean of the level below, a
beta-binomial whose strength comes from the spread between the groups of that level (method of moments). A
host is blocked if its posterior puts at least `certain` on a rate of bad pages above `most_bad`, which is the rate of all
labelled pages unless it is given: what is blocked is what the outcomes tell to be worse than the corpus.

The counts are sums by key; the only things gathered on the driver are four sums a level. Host
verdicts are written to the shared folder and joined from there: broadcast only if Spark finds the
files small, otherwise a join that splits hot hosts.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and is judged by
the overall rate; pages without labels and hosts without labelled pages take their prior; a page id
that is null has no outcome; several labels of an id count once, bad if any is; repeated pages are
judged alike; without any label nothing is blocked by reputation; urls of any length are read whole; other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import drop, written

# The rules of the contract (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Public suffixes of more than one label, below which names are registered; a deployment passes the whole list.
SUFFIXES = (
    "ac.at", "co.at", "or.at",
    "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.co", "edu.co", "gov.co", "org.co", "com.cy", "com.ec", "com.eg", "com.gh",
    "com.hk", "edu.hk", "gov.hk", "org.hk", "com.hr",
    "ac.id", "co.id", "go.id", "or.id", "web.id",
    "ac.il", "co.il", "gov.il", "net.il", "org.il",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "nic.in", "org.in",
    "co.ir",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "co.ke", "or.ke", "ac.kr", "co.kr", "go.kr", "or.kr",
    "co.ma", "com.mt", "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx",
    "com.my", "edu.my", "gov.my", "net.my", "org.my", "com.ng", "edu.ng", "gov.ng", "org.ng", "com.np",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "com.pe", "edu.pe", "gob.pe", "com.ph", "edu.ph", "gov.ph", "com.pk", "edu.pk", "gov.pk",
    "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl", "com.pt", "co.rs", "com.ru",
    "com.sa", "edu.sa", "gov.sa", "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg",
    "ac.th", "co.th", "go.th", "or.th", "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr",
    "com.tw", "edu.tw", "gov.tw", "org.tw", "co.tz", "com.ua", "net.ua", "org.ua", "co.ug",
    "ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "sch.uk",
    "com.uy", "com.vn", "edu.vn", "gov.vn", "ac.za", "co.za", "gov.za", "org.za", "co.zm", "co.zw",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com",
)

#: Posterior mass above the bound from which a host is blocked: three to two. Where wrong blocks cost more, it is set higher.
CERTAIN = 0.6
#: Strengths of a prior lie between these, in pages.
STRENGTHS = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without port or login; an IPv4 address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    deep = two.isin(*suffixes) & (bare != two)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(deep, F.substring_index(bare, ".", -3)).otherwise(two)
    address = F.regexp_like(bare, F.lit(r"^\d+\.\d+\.\d+\.\d+$"))
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def strength(groups: int, n: float, k: float, nn: float, kkn: float) -> float:
    """Prior strength of a level from its groups' pages n and bad pages k: sums of 1, n, k, n*n and k*k/n."""
    low, high = STRENGTHS
    if groups < 2 or not 0 < k < n:
        return high
    p = k / n
    spread = (kkn - k * p) / (p * (1 - p))
    scale = n - nn / n - (groups - 1)
    rho = (spread - (groups - 1)) / scale if scale > 0 else 0.0
    return high if rho <= 1 / (high + 1) else min(high, max(low, 1 / rho - 1))


def _fraction(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(a), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-12).all():
            break
    return h


def beta_above(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(rate > x) under Beta(a, b)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((log_gamma(a + b) - log_gamma(a) - log_gamma(b)).astype(float) + a * math.log(x) + b * math.log1p(-x))
    left = x < (a + 1) / (a + b + 2)
    below = np.where(left, front * _fraction(a, b, x) / a, 1 - front * _fraction(b, a, 1 - x) / b)
    return 1 - np.clip(below, 0, 1)


def reputation(pages: DataFrame, outcomes: DataFrame, most_bad: float | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, k, a, b (the posterior), rate (its mean) and above (its mass over most_bad, unless given the rate of all
    labelled pages) of every host.

    pages: id, host; outcomes: id, bad (boolean)."""
    spark = pages.sparkSession
    bad = outcomes.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    counted = pages.join(bad, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("k"))
    domain, suffix = domain_of(F.col("host"), suffixes)
    hosts, hosts_at = written(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains, domains_at = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "domains")
    tops, tops_at = written(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")), "suffixes")

    def moments(df: DataFrame, n: str, k: str) -> tuple[float, float, float]:
        r = df.where(F.col(n) > 0).agg(F.count(F.lit(1)), F.sum(n), F.sum(k), F.sum(F.col(n) * F.col(n)), F.sum(F.col(k) * F.col(k) / F.col(n))).first()
        return strength(r[0], *(float(x or 0) for x in r[1:])), float(r[1] or 0), float(r[2] or 0)

    top_strength, n, k = moments(tops, "sn", "sk")
    overall = (k + 0.5) / (n + 1) if n else 0.0
    domain_strength, host_strength = moments(domains, "dn", "dk")[0], moments(hosts, "n", "k")[0]
    mean = lambda m, prior, k, n: (F.lit(m) * prior + F.col(k)) / (F.lit(m) + F.col(n))
    tops = tops.withColumn("sr", mean(top_strength, F.lit(overall), "sk", "sn")).select("suffix", "sr")
    rates, rates_at = written(domains.join(tops, "suffix").withColumn("dr", mean(domain_strength, F.col("sr"), "dk", "dn")).select("domain", "suffix", "dr"), "rates")
    out = hosts.join(rates, ["domain", "suffix"]).withColumns(
        {"a": host_strength * F.col("dr") + F.col("k"), "b": host_strength * (1 - F.col("dr")) + F.col("n") - F.col("k")}
    )

    bound = overall if most_bad is None else most_bad

    @F.pandas_udf("double")
    def above(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(beta_above(np.maximum(a.to_numpy(float), 1e-6), np.maximum(b.to_numpy(float), 1e-6), bound) if n else np.zeros(len(a)))

    out = out.select("host", "domain", "suffix", "n", "k", "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), above("a", "b").alias("above"))
    out, _ = written(out, "reputation")
    drop(spark, hosts_at, domains_at, tops_at, rates_at)
    return out


def judged(
    pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    most_bad: float | None = None, certain: float = CERTAIN, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """id, host, path, rule, verdict, rate and above (null where a rule decides) of every page; outcomes: id, bad."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).na.fill("", ["host", "path"])
    known = reputation(rows, outcomes.select(F.col("id").cast(rows.schema["id"].dataType), "bad"), most_bad, suffixes).select("host", "rate", "above")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(known, "host", "left").withColumns({"rule": rule, "v": verdict})
    by_host = F.when(F.col("above") >= certain, F.lit("block")).otherwise(F.lit("allow"))
    open_ = F.col("rule").isNull()
    return out.select(
        F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("v", by_host).alias("verdict"), F.when(open_, F.col("rate")).alias("rate"), F.when(open_, F.col("above")).alias("above")
    )
