"""URL filters: path rules, and trust and distrust spread over host links.

Rules are (host, path, verdict).  A rule fits its host and all subdomains if the
url's path starts with the rule's; the longest rule wins (host and path counted
together; of equal ones the first in text order).  Rules are looked up per
distinct host, so a hot host is matched once.

Hosts without a fitting rule get the method's verdict.  Hosts whose pages the
rules allow are trusted seeds, hosts whose pages they block are blocked seeds,
each weighted by its share of pages.  Trust is a personalised PageRank along links
from trusted seeds, distrust one along reversed links from blocked seeds, so a host
that links to blocked ones is distrusted.  Links are the ``href``s of pages to other
hosts, and both ways between a host and the nearest parent domain that is a host
here.  Both ranks sum to 1; a host is blocked if its distrust exceeds
``threshold`` times its trust.

A rank is what walks from the seeds leave at each host, if they go on along a link with
probability ``FOLLOW``, as a share of all that they leave (so walks that end at hosts without links return
to the seeds).  Each round passes what moves one link on; what moves falls by ``FOLLOW`` a round
at least, and rounds end when it is below ``TOLERANCE`` of the seeds: 86 rounds at most, whatever
the graph, so a host at the end of a long chain of links has a rank too.  Links of a host are dealt
over rows of about ``TARGETS``, and tables by host go to the tasks whole if they have at most
``BROADCAST_HOSTS`` rows, so a host with a third of all pages or links is no one task's.

Defined cases: a url that is null or has no ``://`` has the empty host and path and
fits no rule; the empty host is no node and is allowed; hosts that no seed reaches
are allowed; null html has no links; repeated rows are judged each (and count as
pages); very long urls and pages are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulesift.session import materialize

FOLLOW = 0.85
#: What may still move when the rounds end, as a share of the seeds.
TOLERANCE = 1e-6
#: Rounds between two written tables.
ROUNDS = 6
TARGETS = 1000
BROADCAST_HOSTS = 500_000
Rules = list[tuple[str, str, str]]

#: Links of a page's HTML, as text after href= in a tag.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without it."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parents(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (path, length, rule, verdict) that fit each host, whatever the path."""
    near = hosts.select("host", F.explode(_parents(F.col("host"))).alias("domain"))
    return (near.join(rules.withColumnRenamed("host", "domain"), "domain")
            .groupBy("host").agg(F.collect_list(F.struct((-F.length(F.concat("domain", "path"))).alias("length"), F.concat("domain", "path").alias("rule"), "path", "verdict")).alias("rules")))


def _to_tasks(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_HOSTS`` rows."""
    return F.broadcast(table) if table.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else table


def ranks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind over its edges (kind, src, dst, weight) from its
    seeds (kind, host, seed); the ranks of a kind sum to 1."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"), F.ceil(F.count("*") / TARGETS).alias("rows"))
    shares = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), F.pmod(F.xxhash64("dst"), F.col("rows")).alias("row"), F.struct("dst", (F.col("weight") / F.col("all")).alias("share")).alias("to"))
    targets = shares.groupBy("kind", "host", "row").agg(F.collect_list("to").alias("targets"))
    first = F.row_number().over(W.partitionBy("kind", "host").orderBy("row")) == 1
    targets = _to_tasks(materialize(targets.withColumn("first", first).drop("row"), "targets"))
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    state = materialize(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("moves"), F.lit(0.0).alias("stays")), "ranks")
    # what a host holds stays; what moves goes on to its targets
    own = F.when(F.coalesce("first", F.lit(True)), F.array(F.struct(F.col("host"), F.lit(0.0).alias("moves"), (F.col("moves") + F.col("stays")).alias("stays")))).otherwise(F.array())
    passed = F.transform(F.coalesce("targets", F.array()), lambda t: F.struct(t["dst"].alias("host"), (FOLLOW * F.col("moves") * t["share"]).alias("moves"), F.lit(0.0).alias("stays")))
    while (state.groupBy("kind").agg(F.sum("moves").alias("m")).agg(F.max("m")).first()[0] or 0) > TOLERANCE:
        for _ in range(ROUNDS):
            state = state.join(targets, ["kind", "host"], "left").select("kind", F.explode(F.concat(own, passed)).alias("x")).select("kind", "x.*")
            state = state.groupBy("kind", "host").agg(F.sum("moves").alias("moves"), F.sum("stays").alias("stays"))
        state = materialize(state, "ranks")
    all_ = state.groupBy("kind").agg(F.sum(F.col("moves") + F.col("stays")).alias("all"))  # a row per kind
    return state.join(F.broadcast(all_), "kind").select("kind", "host", ((F.col("moves") + F.col("stays")) / F.col("all")).alias("rank"))


def _domain_edges(hosts: DataFrame) -> DataFrame:
    """Host to the nearest parent domain that is a host itself, both ways."""
    near = hosts.select("host", F.posexplode(_parents(F.col("host"))).alias("steps", "domain")).where("steps > 0")
    nearest = (near.join(hosts.withColumnRenamed("host", "domain"), "domain")
               .groupBy("host").agg(F.min(F.struct("steps", "domain")).alias("n")).select("host", "n.domain"))
    return nearest.select(F.col("host").alias("src"), F.col("domain").alias("dst")).union(nearest.select("domain", "host"))


def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 1.0) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row; trust and distrust are the host's ranks."""
    spark = pages.sparkSession
    rule_table = spark.createDataFrame(rules or [("", "", "")], "host string, path string, verdict string").where("host <> ''").dropDuplicates(["host", "path"])
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    hosts = materialize(urls.where("host <> ''").groupBy("host").count(), "hosts")
    fitting = rules_of_hosts(hosts, rule_table)
    best = F.array_min(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    fitting = _to_tasks(materialize(fitting, "host_rules"))
    judged = urls.select("id", "host", "path").join(fitting, "host", "left").withColumn("best", best).select("id", "host", "path", "best.rule", "best.verdict")
    judged = materialize(judged, "judged")

    by_verdict = judged.where("verdict IS NOT NULL").groupBy("host", "verdict").count()
    seeds = by_verdict.join(hosts.withColumnRenamed("count", "pages"), "host").select(
        F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("count") / F.col("pages")).alias("seed"))
    links = (urls.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
             .select(F.col("host").alias("src"), host_of(F.regexp_replace("href", "^//", "http://")).alias("dst")).where("dst <> '' AND src <> dst"))
    edges = links.union(_domain_edges(hosts.select("host"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    rank = ranks(materialize(both, "links"), seeds)
    of_host = rank.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    of_host = _to_tasks(materialize(of_host, "host_ranks"))

    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when(distrust > threshold * trust, "block").otherwise("allow"))
    return judged.join(of_host, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
