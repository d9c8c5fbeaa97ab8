"""URL filters: allow and block rules, and for urls no rule decides, trust and distrust spread over host edges.

Hosts whose urls a rule allows are seeds of trust, those whose urls one blocks seeds of distrust, each with the
share of its urls. Trust follows edges (personalised PageRank from the trusted seeds); distrust goes against them,
from a blocked host to the hosts that link to it. Both are power series, one join and one sum a term; a host is
blocked where its distrust exceeds its trust by a threshold. Edges are links between hosts, weighted by pages; the pages
of a host, as an edge to itself; and a light edge both ways between a domain and the one right above it.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pubmetrics.llm.store import shared_folder, stored

#: Scheme, host and path of a url; host and path are empty where there is no "://".
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host of an absolute or protocol-relative link.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
TOLERANCE = 0.01
THRESHOLD = 0.25
#: Labels of the longest domain that stands between others.
MAX_LABELS = 8
RANK = "kind string, host string, x double"


def lowered(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): for each host that has any, the rules of its own and of its parent domains, longest first.

    ``hosts`` are distinct, so this grows with hosts and not with urls; a row holds the rules of one line of domains.
    """
    rules = rules.select(lowered(F.col("host")).alias("at"), F.col("path").alias("under"), "verdict").distinct()
    rules = rules.withColumn("rule", F.concat("at", "under"))
    labels = rules.agg(F.max(F.size(F.split("at", r"\.")))).first()[0] or 0
    if not labels:
        return hosts.select("host").where("false").withColumn("fits", F.lit(None).cast("array<struct<under:string,rule:string,verdict:string>>"))
    # The last k labels of a host, for all k that a rule has.
    ends = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, labels + 1))))
    found = hosts.select("host", F.explode(ends).alias("at")).join(rules, "at")
    entry = F.struct((-F.length("rule")).alias("less"), "rule", "under", "verdict")
    fits = found.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("fits"))
    return fits.select("host", F.transform("fits", lambda r: F.struct(r["under"].alias("under"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))).alias("fits"))


def judged_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ..) with the longest rule that fits host and path, and its verdict; both null where none does.

    Of equally long ones the first by text decides, and then allow before block.
    """
    hosts = urls.where("host <> ''").select("host").distinct()
    one = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["under"])), F.lit(0))
    found = urls.join(fitting(hosts, rules), "host", "left").withColumn("one", one)
    return found.select(*urls.columns, "one.rule", F.col("one.verdict").alias("decided"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of a host that link to another host, from ``pages`` (host, html)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), lowered))
    pairs = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.when(F.size(found) > 0, found)).alias("dst"))
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def families(hosts: DataFrame, weight: float) -> DataFrame:
    """(src, dst, weight) both ways between each domain and the one right above it, up to one of two labels.

    ``hosts`` (host, ..) are distinct. Of a host of more than MAX_LABELS labels, the last ones have such edges.
    """
    ends = [F.substring_index("host", ".", -k) for k in range(2, MAX_LABELS + 1)]
    steps = F.array(*(F.struct(below.alias("below"), above.alias("above")) for above, below in zip(ends, [*ends[1:], F.col("host")])))
    steps = hosts.select(F.explode(steps).alias("s")).select("s.*").where("below <> above AND above LIKE '%.%'").distinct()
    ways = F.explode(F.array(F.struct(F.col("below").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("below").alias("dst"))))
    return steps.select(ways.alias("e")).select("e.*", F.lit(float(weight)).alias("weight"))


def shares(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, share): trust goes along an edge, distrust against it; the shares of a source add up to 1."""
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")
    ways = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    moves = edges.select(ways.alias("e"), "weight").select("e.*", "weight")
    total = moves.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    return moves.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def spread(seeds: DataFrame, moves: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, x): 1 - damping times the sum over k of (damping * moves)^k applied to ``seeds`` (kind, host, x).

    That is personalised PageRank whose parts add up to those of the seeds. Every term is written to the
    shared folder, which cuts the lineage. What a term adds up to falls by ``damping`` at least each time, so the terms
    end after log(tolerance) / log(damping) steps at most: 29 by default. The rest, left out, adds up to less than
    ``tolerance`` of all seeds.
    """
    if not 0 < damping < 1 or tolerance <= 0:
        raise ValueError("damping must be between 0 and 1 and tolerance above 0")
    spark = seeds.sparkSession
    folder, paths = shared_folder(spark, "host-terms"), []
    read = spark.read.schema(RANK)
    term, first = seeds.select("kind", "host", "x"), None
    while True:
        seen = Observation()
        paths.append(f"{folder}/{len(paths)}")
        term.observe(seen, F.sum("x").alias("mass")).write.parquet(paths[-1])
        mass = seen.get["mass"] or 0.0
        first = mass if first is None else first
        if mass <= tolerance * first:
            return read.parquet(*paths).groupBy("kind", "host").agg((F.sum("x") * (1 - damping)).alias("x"))
        moved = read.parquet(paths[-1]).withColumnRenamed("host", "src").join(moves, ["kind", "src"])
        term = moved.groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("x") * F.col("share")) * damping).alias("x"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
    family: float = 1.0,
) -> DataFrame:
    """Per row: key, host, path, the longest rule (host, path, verdict) that fits, verdict, and the host's trust and distrust.

    A rule fits its host and all subdomains, where the path starts with the rule's. Where none fits, the host decides:
    block if distrust - trust >= ``threshold``, else allow. A host all of whose urls are blocked and that no other
    one reaches has distrust 1, but for ``tolerance``. Edges are links in ``html`` (none where null), weighted by pages, the pages of a
    host as an edge to itself, and with weight ``family`` (pages; 0: none) a domain and the one right above it. A null url, or one without "://", has empty host and path, fits no rule and is allowed. Repeated
    rows stay, null keys too; an empty table gives no row; without rules everything is allowed.

    Urls are matched once and stored with host, path and rule only; the html is read once, for its links. Urls of a hot
    host meet one row of a host table, which is broadcast if small, else adaptive skew handling splits that host's urls.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = stored(judged_by_rules(rows, rules), "host-rules")
    part = lambda v: (F.count_if(F.col("decided") == v) / F.count("*"))
    shared = judged.where("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"), F.count("*").cast("double").alias("pages"))
    shared = stored(shared, "host-seeds")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in ("trust", "distrust"))))
    seeds = shared.select("host", kinds.alias("s")).select("s.kind", "host", "s.x").where("x > 0")
    edges = shared.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.col("pages").alias("weight"))
    edges = edges.unionByName(families(shared.select("host"), family))
    if html is not None:
        edges = edges.unionByName(links(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))))
    rank = spread(seeds, stored(shares(edges), "host-moves"), damping, tolerance)
    # Rounded, so that the order of sums never decides.
    of = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("x"))), F.lit(0.0)), 9)
    ranked = stored(rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")), "host-ranks")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    found = judged.join(ranked, "host", "left").select("key", "host", "path", "rule", "decided", zero("trust"), zero("distrust"))
    own = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return found.select("key", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "trust", "distrust")
