"""URL verdicts by rules, and by trust and distrust that spread over the link graph of hosts.

A rule is a host and the beginning of a path; it holds for the host and all its subdomains, and of
several that fit the longest wins. Pages without a rule are judged by their host. Hosts with pages that
rules allow are trusted seeds, hosts with pages that rules block are blocked seeds. Trust follows links
forward from the trusted seeds (personalised PageRank), distrust follows them backward from the blocked
ones, since who links to bad hosts is suspect. A seed restarts with UNIT parts, times the part of its ruled pages that are allowed
for trust, or blocked for distrust. Mass that reaches a host without links leaves, so each seed's share in each score is its own, and no verdict
moves with seeds from which no links lead to its host. A host is blocked when its distrust is above its trust.

Links are counted per pair of hosts before the shuffle, so a host with most of the pages is a few rows.
In each round the scores are joined to the edges by host and a salt of the other end, as many salts as the
host with most edges needs, so that its edges are spread; pages meet the scores in a join whose hot hosts can be split. Scores are written every few rounds. The query goes on until, from one written
table to the next, no host is new and no score changes by more than a part in SETTLED of itself or of a
seed's share; one count a table reaches the driver. Callers may fix the number of rounds instead. Scores are integers, so every engine and every order of adding gives the same.

Defined cases: null urls, and urls without ``://``, have an empty host and path and no rule; an empty
host has no links and is allowed; null html has no links; links without ``://`` stay on the page's
host, as do links to it, and don't count; without seeds nothing is blocked; repeated rows are judged
each, and count as links each; pages of any length are read whole; other columns are left aside.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

#: (host, beginning of the path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ROUNDS = 12
SETTLED = 10**6
#: Of 100 parts of a score, so many follow links; the rest goes back to the seeds.
DAMPING = 85
#: Parts of a seed: a host's score stays below 2**63 with 10**9 seeds.
UNIT = 10**9
#: Edges of a host that one task meets, about.
SALTED = 100_000
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of a page by rules alone; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2])):  # of equal length, block wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    found = pages.select(host_of(pages["url"]).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(pages["html"], F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)))).alias("to"))
    found = found.withColumn("dst", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def settled(before: DataFrame, after: DataFrame, share: int) -> bool:
    old = before.select("host", F.col("score").alias("old"))
    changed = f"old is null or score is null or abs(score - old) > greatest({share}L, score) div {SETTLED}"
    return after.join(old, "host", "full").where(changed).isEmpty()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, score): PageRank over edges (src, dst, n) that restarts at the hosts of seeds (host, score); without rounds until it has settled."""
    seeds = written(seeds.select("host", "score"), "seeds")
    back = scores = kept = seeds.select("host", F.expr(f"score * {100 - DAMPING} div 100").alias("score"))
    outs = written(edges.groupBy("src").agg(F.sum("n").alias("out"), F.count("*").alias("degree")), "outs")
    most = outs.agg(F.max("degree").alias("most")).first().most
    if not most or seeds.isEmpty():  # nothing flows
        return scores
    salts = max(SALTS, -(-most // SALTED))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    edges = edges.withColumn("salt", F.expr(f"pmod(xxhash64(dst), {salts}L)")).join(outs.select("src", "out", every.alias("salt")), ["src", "salt"])
    edges = written(edges, "edges")
    for k in itertools.count() if rounds is None else range(rounds):
        salted = scores.withColumn("salt", every)
        flow = salted.join(edges, (salted["host"] == edges["src"]) & (salted["salt"] == edges["salt"]))
        flow = flow.select(F.col("dst").alias("host"), F.expr(f"cast(cast(score as decimal(20)) * {DAMPING} * n div (cast(100 as decimal(20)) * out) as bigint)").alias("score"))
        scores = flow.union(back).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 3 == 2 or rounds is not None and k == rounds - 1:
            scores = written(scores, "scores")
            if rounds is None and settled(kept, scores, UNIT):
                break
            kept = scores
    return scores


def judged(pages: DataFrame, rules=RULES, rounds: int | None = ROUNDS) -> DataFrame:
    """One row per page: host, path, rule, verdict, and its host's trust and distrust."""
    df = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "ruled": verdict})
    seeds = df.where("ruled is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    seeds = written(seeds, "seeds")
    part = lambda c: seeds.where(f"{c} > 0").select("host", F.expr(f"cast(cast({c} as decimal(20)) * {UNIT} div (good + bad) as bigint)").alias("score"))
    edges = written(page_links(pages), "links")
    trust = propagated(edges, part("good"), rounds).withColumnRenamed("score", "trust")
    distrust = propagated(edges.selectExpr("dst as src", "src as dst", "n"), part("bad"), rounds).withColumnRenamed("score", "distrust")
    hosts = trust.join(distrust, "host", "full").selectExpr("host", "coalesce(trust, 0) as trust", "coalesce(distrust, 0) as distrust")
    out = df.join(hosts, "host", "left")
    score = F.when(F.coalesce(F.col("distrust"), F.lit(0)) > F.coalesce(F.col("trust"), F.lit(0)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", score).alias("verdict"), F.coalesce("trust", F.lit(0).cast("long")).alias("trust"), F.coalesce("distrust", F.lit(0).cast("long")).alias("distrust"))


def op2(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rounds=None)
