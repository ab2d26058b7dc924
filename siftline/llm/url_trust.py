"""URL verdicts: rules first, then trust and distrust over the graph of hosts.

Rules name a host and a path and fit that host and its subdomains, if the url's path starts with
the rule's; of those that fit, the longest wins. Hosts whose pages are allowed by rule at least
half of the time are trusted seeds, those blocked at least half of the time are blocked seeds.

Links between hosts are taken from the pages, counted by pair of hosts before they are shuffled, and
carry two personalised PageRanks: trust flows from trusted seeds along links, distrust from blocked
seeds against them (who links to bad hosts is suspect), until what a score can still gain is far
below the margin. A url that no rule fits is blocked if its
host's distrust exceeds its trust by `margin`, and else allowed.

The host is what stands after the first :// up to /, ? or #, with A-Z lowered; the path is what
follows, up to ? or #. Null urls and urls without :// have an empty host and path, which no rule
fits, and are allowed. Null ids and repeated rows give rows like others. Link targets without a host
stay within the page's own host and make no edge.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
#: more rules than this are joined by host suffix instead of being written into the plan
INLINE_RULES = 200


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (null if none), as an expression: for up to INLINE_RULES rules."""
    if len(rules) > INLINE_RULES:
        raise ValueError(f"more than {INLINE_RULES} rules: use match_rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last to fit is the longest
        name, start = split_rule(rule)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (columns key, host, path; key unique) with rule and verdict, for rule tables of any size (columns rule, verdict)."""
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = urls.select("key", "host", "path", F.explode(suffix).alias("_suffix"))
    named = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("_suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("_start"))
    hits = spread.join(named, "_suffix").where(F.col("path").startswith(F.col("_start")))
    best = hits.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("_best"))
    return urls.join(best, "key", "left").select("key", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int | None = 12, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, weight) and seeds (host, kind): kind is trust or distrust, a seed has weight 1.

    With rounds None, rounds go on until no host's score can still grow by more than tolerance. Scores only grow from round
    to round, and the sum of what they grow by falls by damping at least, so the growth of their sum bounds all that is left.
    """
    both = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    out = both.groupBy("src", "kind").agg(F.sum("weight").alias("total"))
    flow = scratch.save(both.join(out, ["src", "kind"]).select("src", "dst", "kind", (F.lit(damping) * F.col("weight") / F.col("total")).alias("share")), "flow")
    start = scratch.save(seeds.select("host", "kind", F.lit(1 - damping).alias("score")), "seeds")
    ranks = start
    if flow.limit(1).count():
        total, left = 0.0, damping**3 / (1 - damping**3)
        for turn in count() if rounds is None else range(rounds):
            moved = flow.join(ranks.withColumnRenamed("host", "src"), ["src", "kind"]).select(F.col("dst").alias("host"), "kind", (F.col("share") * F.col("score")).alias("score"))
            ranks = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            if turn % 3 == 2:
                ranks = scratch.save(ranks, f"ranks-{turn}")
                scratch.drop(f"ranks-{turn - 3}")
                if rounds is None:
                    before, total = total, ranks.agg(F.sum("score")).first()[0] or 0.0
                    if (total - before) * left <= tolerance:
                        break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", margin: float = 0.01, rounds: int | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) for every row of pages. rules: rule -> allow or block; rounds: until scores are settled to a hundredth of margin if None."""
    scratch = Scratch(pages.sparkSession, "url-trust")
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    if len(rules) <= INLINE_RULES:
        split = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
        ruled = split.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.lit(None).cast("map<string,string>")
        ruled = ruled.withColumn("by_rule", verdicts[F.col("rule")])
    else:
        keyed = scratch.save(pages.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("key"), host.alias("host"), path.alias("path")), "keyed")
        table = pages.sparkSession.createDataFrame(list(rules.items()), "rule string, verdict string")
        ruled = match_rules(keyed.drop("_id"), table).join(keyed.select("key", "_id"), "key").withColumnRenamed("verdict", "by_rule").drop("key")
    share = lambda v: F.avg((F.col("by_rule").eqNullSafe(F.lit(v))).cast("double"))
    per_host = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    kind = F.when(F.col("blocked") >= 0.5, "distrust").when(F.col("allowed") >= 0.5, "trust")
    seeds = per_host.select("host", kind.alias("kind")).where("kind is not null")
    edges = scratch.save(host_edges(pages, host, html_col), "edges")
    # written out, so that its size is known when the pages are joined: small tables are broadcast, others shuffled
    scores = scratch.save(propagate(edges, seeds, scratch, rounds, tolerance=margin / 100), "scores")
    judged = ruled.join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_graph = F.when(distrust - trust > margin, "block").otherwise("allow")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
