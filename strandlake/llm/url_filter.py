"""URL filters: host and path rules first, then trust and distrust propagated over the host graph.

Seeds come from the rules: a host is a trusted seed where allow rules decide more of its pages than block rules, and a blocked seed
where block rules decide more than half of all its pages; a caller may name more blocked hosts. The graph has the links between hosts
(relative links stay on their host and give none), and an edge both ways between each host and its parent domain, down to the
registered name of two parts, as hosts of one domain answer for each other. Trust is a personalised PageRank from trusted seeds along
edges; distrust is one from blocked seeds against them: who links to a bad host is suspect. Each seed gives a mass of one, so that
neither side gains by having more or fewer seeds. A host whose distrust exceeds its trust is blocked, every other host is allowed.

Everything is DataFrame operations. A power step joins the mass that moves with edges; edges are dealt out by (source, salt), with
the mass of a source repeated for each salt, so that a hub's links spread over tasks; incoming mass is summed before it is sent. Both
ranks move in the same steps. What moves shrinks by the damping with each step, so that the number of steps that TOLERANCE takes is
known beforehand and none is left out.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; null html has no links; an empty host
takes no part in the graph and is allowed; pages that repeat are judged each; a graph without edges leaves ranks at the seeds;
columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import discard, materialize, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DAMPING = 0.85
#: Share of all mass that may still be on its way when the steps end.
TOLERANCE = 1e-4
#: Links of one source that one salt holds.
PER_SALT = 10_000
#: Blocked hosts that are broadcast, at most 256 bytes each.
BROADCAST_HOSTS = 100_000
PAGE_SALTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does. Rules of equal length go by their order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first, as the outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) to src, dst, weight: links between different hosts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.where(F.contains("link", F.lit("//"))).select("src", host_of(full).alias("dst")).where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """hosts(host) to src, dst, weight: each host with its parent domain and that with its own, both ways, down to two parts."""
    parts = F.split("host", r"\.", -1)
    n = F.size(parts)
    chain = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, k, n - k + 1), "."))
    up = hosts.where((n > 2) & ~F.col("host").rlike(r"^[0-9.]+(:[0-9]*)?$")).select(F.explode(F.arrays_zip(F.slice(chain, F.lit(1), n - 2).alias("src"), F.slice(chain, F.lit(2), n - 2).alias("dst"))).alias("e")).select("e.src", "e.dst").distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.select("src", "dst", F.lit(1).cast("long").alias("weight"))


def _dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(kind, src, dst, weight) to shares(kind, src, salt, dst, share) and degrees(kind, src, salts)."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"), F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    shares = edges.join(out, ["kind", "src"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst", (F.col("weight") / F.col("all")).alias("share"))
    return materialize(shares, "host-shares"), materialize(out.select("kind", "src", "salts"), "host-degrees")


def steps_for(damping: float, tolerance: float) -> int:
    """Steps after which no more than the tolerance's share of the mass still moves."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate_all(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges(kind, src, dst, weight) and seeds(kind, host, mass) to kind, host, rank; the ranks of a kind add up to its seeds' mass.

    The rank is what the seeds send in all steps together, each step's mass damped; to scale that to the seeds' mass is the same as to
    send the mass of hosts without links back to the seeds.
    """
    shares, degrees = _dealt(edges)
    hubs = degrees.where("salts > 1").take(1)  # without any, there is nothing to repeat
    total = {r["kind"]: r["m"] for r in seeds.groupBy("kind").agg(F.sum("mass").alias("m")).collect()}
    moving = materialize(seeds.select("kind", "host", F.col("mass").cast("double").alias("rank")), "host-moves")
    done = [moving]
    for _ in range(steps_for(damping, tolerance) if shares.take(1) else 0):
        spread = moving.select("kind", F.col("host").alias("src"), "rank", F.lit(0).alias("salt"))
        if hubs:
            spread = spread.drop("salt").join(degrees, ["kind", "src"]).select("kind", "src", "rank", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        moved = spread.join(shares, ["kind", "src", "salt"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(damping * F.col("rank") * F.col("share")).alias("rank"))
        moving = materialize(moved, "host-moves")
        done.append(moving)
        if len(done) > 8:
            done, old = [materialize(_summed(done), "host-sums")], done
            for x in old[:-1]:  # the last of them still moves
                discard(x)
            if not moving.take(1):
                break
    ranks = materialize(_summed(done), "host-sums")
    scale = {r["kind"]: total[r["kind"]] / r["s"] for r in ranks.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
    factor = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(scale[k])), scale, F.when(F.lit(False), F.lit(0.0)))
    return ranks.select("kind", "host", (F.col("rank") * factor).alias("rank"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges(src, dst, weight) and seeds(host, mass) to host, rank: one personalised PageRank."""
    return propagate_all(edges.withColumn("kind", F.lit("one")), seeds.withColumn("kind", F.lit("one")), damping, tolerance).drop("kind")


def judge_hosts(pages: DataFrame, blocked: Column | None = None) -> DataFrame:
    """pages(host, html, ruled) to host, trust, distrust of hosts that have either; blocked: a test of host for more blocked seeds."""
    by_host = pages.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("refused"), F.count("*").alias("n"))
    links = materialize(host_edges(pages), "host-links")
    # hosts that are only linked to can be seeds too
    none = F.lit(0).cast("long")
    every = by_host.unionByName(links.select(F.col("dst").alias("host")).distinct().select("host", none.alias("allowed"), none.alias("refused"), none.alias("n")))
    bad = F.col("refused") * 2 > F.col("n")
    hosts = every.groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("refused").alias("refused"), F.sum("n").alias("n"))
    hosts = materialize(hosts.withColumn("bad", bad if blocked is None else bad | blocked), "hosts")
    edges = materialize(links.unionByName(domain_edges(hosts.select("host"))), "host-edges")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    kind = F.when(F.col("bad"), "distrust").when(F.col("allowed") > F.col("refused"), "trust")
    seeds = hosts.select(kind.alias("kind"), "host", F.lit(1.0).alias("mass")).where("kind IS NOT NULL")
    ranks = propagate_all(both, seeds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: Column | None = None) -> DataFrame:
    """pages(page_id, url, html) to page_id, host, path, rule, verdict. blocked: a test of host for blocked seeds besides those of the rules."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = cut.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    hosts = judge_hosts(ruled.select("host", "html", F.col("__r.verdict").alias("ruled")), blocked)
    # masses that tell nothing apart are rounding
    bad = materialize(hosts.where(F.col("distrust") > F.col("trust") * (1 + 1e-9)).select("host"), "bad-hosts")
    plain = ruled.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("ruled"))
    if bad.count() <= BROADCAST_HOSTS:
        judged = plain.join(F.broadcast(bad.withColumn("__bad", F.lit(True))), "host", "left")
    else:  # a host may have a third of the pages
        salted = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(PAGE_SALTS - 1))).alias("__salt"), F.lit(True).alias("__bad"))
        judged = plain.withColumn("__salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(PAGE_SALTS)).cast("int")).join(salted, ["host", "__salt"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("__bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
