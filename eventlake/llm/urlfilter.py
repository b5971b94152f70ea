"""URL verdicts from rules and from the link graph of hosts, on DataFrame functions alone.

Rules decide what they fit. For the rest, trust and distrust spread over the graph of links
between hosts: personalised PageRank starts at hosts with pages that rules allow and follows
links, distrust starts at hosts with pages that rules block and follows links backwards (who
links to bad hosts is suspect). A host whose distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DAMPING = 0.85
#: Most rounds, and the share of all rank that four rounds may still move when they end sooner.
ROUNDS, STILL = 60, 1e-6
#: Hosts whose rules or scores are broadcast to the pages (some hundred bytes each); more meet them by shuffle.
BROADCAST_HOSTS = 100_000
#: Blocked: distrust above RATIO * trust by more than MARGIN of either, which is rounding noise.
RATIO, MARGIN = 1.0, 1e-9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule_verdict) rows from (host, path, 'allow' or 'block') tuples."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of a host and of the domains above it, longest first.

    A host meets rules by equality with one of its suffixes, so neither side is broadcast unless
    Spark finds it small.
    """
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    entry = F.struct(
        (-F.length("rule_host") - F.length("rule_path")).alias("order"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_path").alias("path"),
        F.col("rule_verdict").alias("verdict"),
    )
    return fit.groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("rules"))


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Distinct (src, dst) of links from one host to another; relative links stay on their host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"), F.lit(1))
    absolute = F.transform(links, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))
    src = host_of(F.col(url_col).cast("string"))
    found = pages.select(src.alias("src"), F.explode(F.array_distinct(absolute)).alias("dst"))
    return found.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).distinct()


def _share(edges: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    """Edges a -> b, each with its part of what flows out of a."""
    out = edges.groupBy(a).agg(F.count("*").alias("degree"))
    return edges.join(out, a).select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), (1.0 / F.col("degree")).alias("share"))


def _near(df: DataFrame) -> DataFrame:
    """``df``, one row a host, to be broadcast if it is short, so that pages of a hot host stay where they are.

    A longer one meets pages by a sort-merge join, whose skewed partitions Spark splits.
    """
    return F.broadcast(df) if df.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else df


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, value): personalised PageRank of each kind, in units of its seeds' sum.

    ``edges`` are distinct (src, dst); ``seeds`` (kind, host, value) with kind 'trust' or
    'distrust'. Trust flows along edges and distrust against them. What reaches a host without
    further edges goes back to the seeds; that scales all ranks of a kind alike, so it is done once
    at the end. Rounds end when four of them move no more than ``STILL`` of the rank.
    """
    flow = written(_share(edges, "trust", "src", "dst").unionByName(_share(edges, "distrust", "dst", "src")))
    seeds = written(seeds)
    start = seeds.select("kind", "host", ((1 - damping) * F.col("value")).alias("value"))
    if flow.isEmpty():
        return seeds
    rank = last = start
    for k in range(rounds):
        moved = flow.join(rank.select("kind", F.col("host").alias("a"), "value"), ["kind", "a"])
        moved = moved.select("kind", F.col("b").alias("host"), (damping * F.col("value") * F.col("share")).alias("value"))
        rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("value").alias("value"))
        if k % 4 == 3:
            rank = written(rank)
            both = rank.unionByName(last.withColumn("value", -F.col("value"))).groupBy("kind", "host").agg(F.sum("value").alias("d"), F.max("value").alias("value"))
            change, total = both.agg(F.sum(F.abs("d")), F.sum("value")).first()
            if (change or 0.0) <= STILL * (total or 0.0):
                break
            last = rank
    # two rows: what each kind's ranks are divided by
    scale = rank.groupBy("kind").agg(F.sum("value").alias("held")).join(seeds.groupBy("kind").agg(F.sum("value").alias("given")), "kind")
    return rank.join(F.broadcast(scale), "kind").select("kind", "host", (F.col("value") * F.col("given") / F.col("held")).alias("value"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = RATIO, margin: float = MARGIN) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule whose host is the page's host or a domain above it and whose path begins the
    page's path decides; else the link graph, in which a host without scores is allowed. Scores are
    compared by ratio and before they are rounded, so that verdicts do not depend on the graph's size. A null
    url, or one without ``://``, has an empty host and path and is allowed. A null html has no
    links. Rows that repeat an id are judged each; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    edges = host_links(pages, url_col, html_col)
    known = written(rules_by_host(slim.select("host").distinct(), rules))
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    ruled = written(slim.join(_near(known), "host", "left").withColumn("fit", fits).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")))
    pages_of = ruled.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust")
    )
    seeds = pages_of.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust") / F.col("n"), F.lit("distrust"), F.col("distrust") / F.col("n"))).alias("kind", "value")).filter("value > 0")
    ranks = propagate(edges, seeds, damping, rounds)
    scores = written(ranks.groupBy("host").agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust"))
    ))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(distrust - ratio * trust > margin * (distrust + ratio * trust), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(_near(scores), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
