"""URL filter: rules by host suffix and path prefix, and link-graph propagation for what no rule decides.

Everything runs as DataFrame operations.

1.  A url's host has a handful of suffixes (a.b.com, b.com, com); the rules are joined on the suffix, the
    longest rule whose path starts the url's path wins. No url meets all rules.
2.  Links in the html give weighted host-to-host edges (relative links stay on the host and give none).
3.  Trust is personalised PageRank from the hosts whose pages rules allow, along the links: a host passes on its trust
    by the shares of its links. Distrust is walked against the links, from the hosts whose pages rules block: a host takes over
    the distrust of what it links to, by the shares of its own links, so that a blocked host which many link to
    taints each of them as much as one which few do. A seed holds its part: what a blocked host links to changes
    nothing about it. A host's seed is the share of its pages so decided. In both a fully decided host has 1.
4.  A host is blocked if its distrust is at least BLOCK_AT, which is what half of its links leading to
    fully blocked hosts come to, and more than its trust; all other hosts are allowed.

The walks are one join and one aggregation of host-sized tables each step, written to the shared folder
so that lineage stays short; they end once all values together are within TOLERANCE of where they settle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parlance.runtime import materialize, small_or_shuffled

DAMPING, TOLERANCE = 0.85, 1e-6
BLOCK_AT = DAMPING / 2

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or no '://'."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """host and all its parents: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls (host, path, ...) with rule and rule_verdict, both null where none fits. urls must be one row per (host, path).

    The longest fitting rule wins, then the one with the longer host, then the greater text.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(r, v, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in rules], "rule string, rule_verdict string, _host string, _path string")
    hits = urls.select("host", "path", F.explode(suffixes(F.col("host"))).alias("_host")).join(small_or_shuffled(table), "_host").filter(F.startswith("path", "_path"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length("_host"), F.col("rule"), F.col("rule_verdict"))).alias("_b"))
    return urls.join(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_b.rule", "_b.rule_verdict"), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


def rule_columns(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """As apply_rules, for a short list of rules, without a join: the rules are tried from the longest."""
    ordered = sorted(rules, key=lambda x: (len(x[1]), len(x[1].split("/", 1)[0]), x[1]), reverse=True)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in reversed(ordered):
        h, p = r.split("/", 1)
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, from href attributes of pages (url, html)."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return found.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def walk(edges: DataFrame, seeds: DataFrame, name: str, held: bool = False, damping: float = DAMPING) -> DataFrame:
    """(host, score): score = seed + d * sum over edges (src, dst, p) of score(src) * p, times 1 - seed if held.

    seeds (host, seed) has every host once, seeds lie in 0 to 1. Either a host's p to all dst (trust) or from all src
    (held) sum to 1 at most, so that the sum, or the largest, of what is missing shrinks by d each step. That bounds
    the steps; a walk that has not settled within them is an error.
    """
    score = materialize(seeds.select("host", "seed", F.col("seed").alias("score")), f"{name}-0")
    if edges.isEmpty():
        return score.select("host", "score")
    total = score.agg(F.max("seed") if held else F.sum("seed")).first()[0] or 0.0
    least = TOLERANCE * (1 - damping) / damping
    steps = 2 + max(0, math.ceil(math.log(least / max(total, least)) / math.log(damping)))
    keep = (1 - F.col("seed")) * damping if held else F.lit(damping)
    change = F.abs(F.col("score") - F.col("old"))
    for step in range(1, steps + 1):
        flow = edges.join(score.select(F.col("host").alias("src"), "score"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        new = score.join(flow, "host", "left").select("host", "seed", F.col("score").alias("old"), (F.col("seed") + F.coalesce(F.col("flow"), F.lit(0.0)) * keep).alias("score"))
        seen = Observation()
        new = materialize(new.observe(seen, (F.max(change) if held else F.sum(change)).alias("moved")), f"{name}-{step}")
        moved = seen.get["moved"]  # counted as the table is written
        score = new.select("host", "seed", "score")
        if moved is None or moved <= least:
            return score.select("host", "score")
    raise RuntimeError(f"{name} has not settled after {steps} steps")


def with_shares(edges: DataFrame) -> DataFrame:
    """Edges as (src, dst, p): p is the share of src's weight. Divides by a joined sum, not a window, as hubs are hot."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("_w"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_w")).alias("p"))


def host_verdicts(pages: DataFrame, ruled: DataFrame, block_at: float = BLOCK_AT) -> DataFrame:
    """(host, trust, distrust, host_verdict) for every host of ruled (host, rule_verdict), from the links of pages."""
    edges = materialize(with_shares(materialize(host_edges(pages), "link-edges")), "link-shares")
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    own = ruled.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"))
    others = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0.0).alias("allow"), F.lit(0.0).alias("block"))
    hosts = materialize(own.unionByName(others).groupBy("host").agg(F.max("allow").alias("allow"), F.max("block").alias("block")), "link-hosts")
    trust = walk(edges, hosts.select("host", F.col("allow").alias("seed")), "link-trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")
    blame = walk(against, hosts.select("host", F.col("block").alias("seed")), "link-blame", held=True)
    both = trust.withColumnRenamed("score", "trust").join(blame.withColumnRenamed("score", "distrust"), "host")
    blocked = (F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust"))
    return both.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, block_at: float = BLOCK_AT, short: int = 64) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    verdict is the rule's, or where no rule fits the host's. A url that is null or has no '://' has empty host
    and path, no rule, and its empty host takes part like any other (it has no links). A null html has no
    links. Up to `short` rules are tried in the projection, more are joined by host suffix. Repeated rows are
    judged alike, and their links count as often; a null page_id stays null; urls of any length are read whole; an empty
    table gives an empty result. Columns other than the three named are neither read nor returned.
    """
    x = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= short:
        ruled = rule_columns(x, rules)
    else:
        keys = apply_rules(x.select("host", "path").distinct(), rules)
        ruled = x.join(keys, ["host", "path"])
    verdicts = small_or_shuffled(materialize(host_verdicts(pages, ruled, block_at), "link-verdicts"))
    return ruled.join(verdicts, "host").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict").alias("verdict"), "trust", "distrust")
