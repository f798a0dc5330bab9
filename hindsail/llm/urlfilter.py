"""URL filters: path rules, then trust propagated over the link graph of hosts.

A page whose url fits a rule gets the longest such rule's verdict. All others
are judged by their host: personalised PageRank starts from trusted seeds and
follows links; distrust starts from blocked seeds and follows links backwards,
from a page that is bad to those that link to it. Seeds are the hosts of pages
that rules allow or block, by their share of such pages. A host is blocked if
its distrust exceeds its trust.

Host edges are the links of a page's HTML to other hosts, relative links (to
the own host: all that name no scheme and no host), and, for domains that share pages between subdomains, an edge
from a host to its parent domain and back. Only DataFrame functions are used;
edges are counted before they are shuffled, so a common host is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

# Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: A host passes on what it has gained once that is more than this part of its rank.
SETTLED = 1e-6
#: Rounds between tables and tests.
EVERY = 4
#: Scores are shares of a whole and shrink as input grows, so they are compared unrounded. A host is blocked if its distrust exceeds its trust by more than this part of it; the margin is wider than what settled ranks may still lack.
TIE = 1e-4
#: Links between a host and its parent domain count as so many links, each way.
KIN = 1.0


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return tuple(F.coalesce(*[F.when(fits(h, p), F.lit(value)) for v, h, p in ordered for value in [(h + p, v)[k]]]) for k in range(2))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from pages(host, html): links counted by the hosts they join."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))).alias("href"))
    whole = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    # a link without scheme and host is the own host's; one of another scheme (mailto:) or to a place in the page leads nowhere
    own = ~whole.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)")
    target = F.when(whole.contains("://"), host_of(whole)).when(own, F.col("host"))
    return links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def host_edges(counted: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): counted links, and edges between hosts(host), or linked ones, and their parents."""
    named = counted.select("src").union(counted.select("dst")).union(hosts.select("host").where("host <> ''")).distinct()
    parts = F.split("src", r"\.")
    parent = named.select("src", F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ".").alias("dst"), F.size(parts).alias("depth")).where("depth > 2")
    kin = parent.select("src", "dst").union(parent.select("dst", "src")).distinct().select("src", "dst", F.lit(KIN).alias("weight"))
    return counted.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tables: Scratch) -> DataFrame:
    """Personalised PageRank (kind, host, rank) for each kind of edges(kind, src, dst, weight) and seeds(kind, host, seed), seeds of a kind summing to 1.

    A host's rank is 1 - DAMPING of its seed plus what DAMPING passes along the
    edges by weight; rank of hosts without edges goes nowhere. A host's links to
    itself, most of what the web has, are summed as the geometric series that
    they are, so rounds only carry what moves between hosts. A host sends on
    what it has gained since it last sent, and only if that is more than SETTLED
    of its rank; so rounds shrink to the hosts that still change, a far end of
    a long chain costs rounds of a few rows, and there is no limit to them.
    """
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
    totals = tables.put("totals", edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"), own.alias("own")))
    stays = 1 - DAMPING * F.col("own") / F.col("total")
    passed = edges.where("src <> dst").join(totals, ["kind", "src"])
    moves = tables.put("moves", passed.select("kind", "src", "dst", (DAMPING * F.col("weight") / F.col("total") / stays).alias("share")))
    # sent: rank that has been passed on; gained: rank that has not
    now, step = tables.put("rank0", seeds.select("kind", "host", F.lit(0.0).alias("sent"), (F.col("seed") * (1 - DAMPING)).alias("gained"))), 0
    moving = F.col("gained") > SETTLED * F.col("sent")
    while not now.where(moving).isEmpty():
        for _ in range(EVERY):
            after = now.select("kind", "host", (F.col("sent") + F.when(moving, F.col("gained")).otherwise(0.0)).alias("sent"), F.when(moving, 0.0).otherwise(F.col("gained")).alias("gained"))
            front = now.where(moving).select("kind", F.col("host").alias("src"), "gained")
            got = front.join(moves, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("sent"), (F.col("gained") * F.col("share")).alias("gained"))
            now = after.union(got).groupBy("kind", "host").agg(F.sum("sent").alias("sent"), F.sum("gained").alias("gained"))
        step += EVERY
        now = tables.put(f"rank{step}", now)
        tables.drop(f"rank{step - EVERY}")
    now = now.select("kind", "host", (F.col("sent") + F.col("gained")).alias("rank"))
    whole = now.join(totals.withColumnRenamed("src", "host"), ["kind", "host"], "left")
    return whole.select("kind", "host", (F.col("rank") / F.coalesce(stays, F.lit(1.0))).alias("rank"))


def seeds_of(judged: DataFrame) -> DataFrame:
    """(kind, host, seed): the host's share of the pages that rules judge so; kind is trust for allowed, distrust for blocked ones."""
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind")
    counted = judged.where(F.col("ruled").isNotNull() & (F.col("host") != "")).groupBy(kind, "host").agg(F.count("*").alias("n"))
    return counted.join(counted.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed"))


def host_scores(edges: DataFrame, seeds: DataFrame, tables: Scratch) -> DataFrame:
    """(host, trust, distrust) from edges(src, dst, weight): trust follows them, distrust goes against them."""
    along = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = propagate(along.union(against), seeds, tables)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages(page_id, url, html).

    A null url, or one without ://, has empty host and path, fits no rule and
    is allowed, as is a host that neither trust nor distrust reaches. Null HTML
    has no links. Repeated rows stay; other columns are left out.
    """
    tables = Scratch(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"))
    judged = tables.put("judged", named)
    counted = tables.put("links", host_links(pages.select(host.alias("host"), "html")))
    edges = tables.put("edges", host_edges(counted, judged))
    scores = tables.put("scores", host_scores(edges, seeds_of(judged), tables))
    bad = F.col("distrust") > F.coalesce("trust", F.lit(0.0)) * (1 + TIE)
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
