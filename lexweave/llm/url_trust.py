"""URL filter by rules, and by trust and distrust spread over the link graph.

A rule names a host and a path prefix and fits that host and its subdomains; the longest fitting
rule decides. Hosts that no rule decides get their verdict from the graph of links between hosts:
personalised PageRank starts at every host with pages that a rule allows, in proportion to their
number, and follows links; distrust starts likewise at every host with blocked pages and runs against
the links, since a host is answerable for what it links to. A host may seed both. A page is blocked
if its host's distrust exceeds its trust and the host's even share of all distrust; else allowed.

Edges are links per pair of different hosts, from absolute and scheme-relative addresses. Each
round is a join of ranks with edges on the host and a combinable sum, and is written to the shared
folder. Rank that reaches a host without links goes back to the seeds. Rounds go on until the summed
change of the ranks is under a thousandth of a host's even share, whatever the number of hosts.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
null html has no links; repeated rows count each time; ties and hosts outside the graph are
allowed. Other columns are left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

#: (verdict, host, path prefix): the rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
#: Rounds end when ranks change by less than this part of an even share; by damping alone that takes
#: 175 rounds for a billion hosts, so more than LIMIT is an error.
SETTLED, LIMIT = 1e-3, 300


def lower_ascii(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict; null where none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        under = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = under & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    rule, verdict = longest_rule(rules)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("rule", rule).withColumn("by_rule", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) over different hosts."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return (
        links.withColumn("dst", lower_ascii(F.col("dst")))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def spread(
    edges: DataFrame, seeds: DataFrame, rounds: int | None = None, hosts: int = 1
) -> DataFrame:
    """Personalised PageRank per ``kind``: edges (kind, src, dst, links), seeds (kind, host, seed).

    As many ``rounds`` as given, or until the ranks have settled for the graph or for ``hosts`` hosts
    if these are more.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    shares = cut_lineage(
        edges.join(out, ["kind", "src"]).select(
            "kind", "src", "dst", (DAMPING * F.col("links") / F.col("all_links")).alias("share")
        )
    )
    seeds = cut_lineage(seeds)
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    if shares.isEmpty():
        return ranks
    ends = shares.select("src").unionByName(shares.select(F.col("dst").alias("src")))
    nodes = ends.unionByName(seeds.select(F.col("host").alias("src"))).distinct().count()
    bound = SETTLED / max(hosts, nodes)
    none = F.lit(0.0)
    for _ in range(LIMIT if rounds is None else rounds):
        passed = (
            ranks.join(shares, (ranks["host"] == shares["src"]) & (ranks["kind"] == shares["kind"]))
            .groupBy(shares["kind"], F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("passed"))
        )
        passed = cut_lineage(passed)
        # Two rows: what the links passed on, per kind. The seeds get the rest.
        moved = passed.groupBy("kind").agg(F.sum("passed").alias("moved"))
        restart = seeds.join(F.broadcast(moved), "kind", "left").select(
            "kind", "host", (F.col("seed") * (1 - F.coalesce("moved", none))).alias("rank"), none.alias("was")
        )
        parts = restart.unionByName(
            passed.select("kind", "host", F.col("passed").alias("rank"), none.alias("was"))
        ).unionByName(ranks.select("kind", "host", none.alias("rank"), F.col("rank").alias("was")))
        sums = F.sum("rank").alias("rank"), F.sum("was").alias("was")
        both = cut_lineage(parts.groupBy("kind", "host").agg(*sums))
        ranks = both.select("kind", "host", "rank")
        if rounds is None:
            changes = both.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change"))
            if (changes.agg(F.max("change")).first()[0] or 0.0) < bound:
                break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {LIMIT} rounds")
    return ranks


def host_scores(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """host, trust, distrust, blocked for every host of the pages or the graph that has a score."""
    per_host = cut_lineage(
        judged(pages, rules)
        .where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"),
        )
    )
    seeds = None
    for kind, count in (("trust", "allowed"), ("distrust", "blocked")):
        own = per_host.where(F.col(count) > 0)
        whole = own.agg(F.sum(count).alias("all_pages"))
        own = own.crossJoin(F.broadcast(whole)).select(
            F.lit(kind).alias("kind"), "host", (F.col(count) / F.col("all_pages")).alias("seed")
        )
        seeds = own if seeds is None else seeds.unionByName(own)
    edges = cut_lineage(host_edges(pages))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        edges.select(
            F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"
        )
    )
    ranks = spread(both, seeds, rounds, per_host.count())
    scores = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"),
    )
    hosts = per_host.agg(F.count("*").alias("hosts"))
    bad = (F.round(F.col("distrust") - F.col("trust"), 9) > 0) & (
        F.round(F.col("distrust") * F.col("hosts"), 9) > 1
    )
    return scores.crossJoin(F.broadcast(hosts)).withColumn("blocked", bad).drop("hosts")


def verdicts(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    scores = host_scores(pages, rules, rounds)
    joined = judged(pages, rules).join(scores, "host", "left")
    by_graph = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_graph).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
