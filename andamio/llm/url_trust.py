"""Operator 1: URL verdicts from rules and from trust that spreads over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query: (verdict, host, path). A rule holds for its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: A round ends the spreading when no host's rank has changed by more than SETTLED of itself, or
#: all ranks together by less than NOTHING of all mass (a walk's mass falls by DAMPING a round,
#: so that is met for any graph).
DAMPING, SETTLED, NOTHING = 0.85, 0.01, 1e-9
#: Out-links of a host that one task may hold.
HUB = 10_000
#: A host's pages are blocked if distrust is more than this share of all that reaches it.
DISTRUSTED = 0.5
#: Labels that the shortest node above a host has.
LEAST_LABELS = 2

_HOST = r"""([^/?#"'\s<>]+)"""
LINK = r"""(?i)\b(?:href|src|action|content|data-href|srcset)\s*=\s*["']?\s*(?:\d+;\s*url=)?(?:https?:)?//""" + _HOST
BASE = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//""" + _HOST
RELATIVE = r"""(?i)\bhref\s*=\s*["']?\s*(?!https?:|//|#|mailto:|javascript:|data:|tel:)[^"'\s>]"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest_first]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return tuple(F.coalesce(*(F.when(fit, F.lit(value(r))) for fit, r in zip(fits, longest_first, strict=True))) for value in (lambda r: r[1] + r[2], lambda r: r[0]))


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts, and between a host and the nodes above it.

    ``pages`` has host and html. Absolute links count, and where a page names another host
    as its base, its relative ones. Above a host stand its suffixes down to two labels,
    whether they have pages or not, each linked with the next in both directions: so hosts
    of one domain are near each other.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.filter("host <> ''").select(F.col("host").alias("source"), html.alias("html"))
    absolute = rows.select("source", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("raw"), F.lit(1).cast("long").alias("n"))
    based = rows.select("source", F.regexp_extract("html", BASE, 1).alias("raw"), F.regexp_count("html", F.lit(RELATIVE)).cast("long").alias("n")).filter("raw <> '' AND n > 0")
    target = F.regexp_replace(common.ascii_lower(F.regexp_replace("raw", r"^[^@]*@", "")), r":\d*$", "")
    links = absolute.unionByName(based).select("source", target.alias("target"), "n").filter("target <> '' AND source <> target").groupBy("source", "target").agg(F.sum("n").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels) - LEAST_LABELS + 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.filter("host <> ''").select("host").distinct().filter(F.size(labels) > LEAST_LABELS).select(suffixes.alias("chain"))
    steps = hosts.select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("low"), F.slice("chain", 2, F.size("chain")).alias("high"))).alias("step")).select("step.low", "step.high").distinct()
    one = F.lit(1).cast("long").alias("n")
    up, down = steps.select(F.col("low").alias("source"), F.col("high").alias("target"), one), steps.select(F.col("high").alias("source"), F.col("low").alias("target"), one)
    return links.unionByName(up).unionByName(down).groupBy("source", "target").agg(F.sum("n").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Personalised PageRank: kind, host, rank from seeds (kind, host, mass) over edges (kind, source, target, n).

    A walk that meets a host without edges ends there. Rounds go on until ranks are
    settled, each relative to itself, so the graph's size and the number of seeds
    do not matter. A host with very many links is cut into parts, each
    of which gets the host's rank. Each round's ranks are written, so plans stay short.
    """
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    out = common.materialise(out, "sources")
    part = F.pmod(F.xxhash64("target"), F.col("parts")).cast("int")
    shares = edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), part.alias("part"), "target", (F.col("n") / F.col("all")).alias("share"))
    shares = common.materialise(shares, "edges")
    parts = out.select("kind", F.col("source").alias("host"), "parts")
    base = common.materialise(seeds.select("kind", "host", (F.col("mass") * (1 - DAMPING)).alias("base")), "seeds")
    none = F.lit(0.0)
    ranks = common.materialise(base.select("kind", "host", F.col("base").alias("rank"), none.alias("change")), "ranks")
    while True:
        asked = ranks.join(parts, ["kind", "host"]).select("kind", "host", "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        moved = asked.join(shares, ["kind", "host", "part"]).select("kind", F.col("target").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("new"), none.alias("old"))
        # What comes in, what seeds have of their own and the rank before meet in one sum.
        every = moved.unionByName(base.select("kind", "host", F.col("base").alias("new"), none.alias("old"))).unionByName(ranks.select("kind", "host", none.alias("new"), F.col("rank").alias("old")))
        sums = every.groupBy("kind", "host").agg(F.sum("new").alias("rank"), F.sum("old").alias("old"))
        step = common.materialise(sums.select("kind", "host", "rank", F.abs(F.col("rank") - F.col("old")).alias("change")), "ranks")
        common.discard(ranks)
        ranks = step
        relative, total = step.agg(F.max(F.when(F.col("rank") > 0, F.col("change") / F.col("rank"))), F.sum("change")).first()
        if (relative or 0.0) <= SETTLED or (total or 0.0) <= NOTHING:
            return ranks.select("kind", "host", "rank")


def host_trust(pages: DataFrame) -> DataFrame:
    """host, trust, distrust from pages with host, html and the rules' ruled verdict.

    Trust flows along links from the hosts with pages that rules allow; distrust flows
    against links, to the hosts that link to those with blocked pages. Every host with
    ruled pages is a seed, of both kinds if it has both, with mass in proportion to the
    share of its pages ruled that way. The masses of a kind sum to 1.
    """
    decided = {kind: (F.count(F.when(F.col("ruled") == verdict, 1)) / F.count(F.lit(1))) for kind, verdict in (("trust", "allow"), ("distrust", "block"))}
    shares = pages.filter("host <> ''").groupBy("host").agg(*(v.alias(k) for k, v in decided.items()))
    shares = shares.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "part")).filter("part > 0")
    shares = common.materialise(shares, "shares")
    total = {r["kind"]: r["total"] for r in shares.groupBy("kind").agg(F.sum("part").alias("total")).collect()}
    mass = F.col("part") / F.when(F.col("kind") == "trust", total.get("trust", 1.0)).otherwise(total.get("distrust", 1.0))
    seeds = shares.select("kind", "host", mass.alias("mass"))
    links = common.materialise(host_links(pages), "links")
    edges = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    ranks = spread(seeds, edges)
    return ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides; else the page's host does, which is blocked
    where distrust is more than DISTRUSTED of what reached it, and allowed otherwise,
    also when nothing reached it. Null urls and urls without ``://`` have an empty
    host and path and no rule; they are allowed. Null html has no links. Repeated rows and null ids are
    judged like any other; no rows in, no rows out; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "html", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    rows = common.materialise(parsed.drop("html"), "pages")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    trust = host_trust(parsed)
    groups = common.materialise(hosts.join(trust, "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "hosts")
    out = common.with_groups(rows, groups, ["host"], "pages")
    blocked = F.col("distrust") > DISTRUSTED * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
