"""URL verdicts: host and path rules first, else trust and distrust spread over host links, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links of a page, with or without a scheme.
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"

DAMPING = 0.85
TOLERANCE = 1e-6
#: A host is blocked if its distrust exceeds its trust by more than that of an unlinked host with this share of blocked pages.
BLOCK_SHARE = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; of equally long ones the first given."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted before they are shuffled. Relative links stay on their host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").count().withColumnRenamed("count", "n")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, max_iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, trust_seed, distrust_seed) and edges (src, dst, n).

    trust = (1 - damping) * seed + damping * sum over linking hosts of their trust by their share of links; distrust the same
    with the links reversed, so that it comes from the hosts a host links to. Iterates until no value moves by more than
    tolerance. The sum of all moves shrinks by damping at least, so that at most log(tolerance / sum of the first values) /
    log(damping) iterations are needed; max_iterations replaces that bound. Raises where the values still move by more after it.
    Each iteration is written to the shared folder: a lost executor repeats one iteration, not all.
    """
    out_sum = edges.groupBy("src").agg(F.sum("n").alias("src_n"))
    in_sum = edges.groupBy("dst").agg(F.sum("n").alias("dst_n"))
    edges = edges.join(out_sum, "src").join(in_sum, "dst").select("src", "dst", (F.col("n") / F.col("src_n")).alias("down"), (F.col("n") / F.col("dst_n")).alias("up"))
    edges = materialise(edges, "host-edges")
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = linked.join(seeds, "host", "full").na.fill(0.0, ["trust_seed", "distrust_seed"])
    keep = F.lit(1 - damping)
    state = hosts.select("host", "trust_seed", "distrust_seed", (keep * F.col("trust_seed")).alias("trust"), (keep * F.col("distrust_seed")).alias("distrust"))
    state = materialise(state, "host-trust")
    if edges.isEmpty():
        return state.select("host", "trust", "distrust")
    if max_iterations is None:
        start = state.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0
        max_iterations = 1 + max(1, math.ceil(math.log(tolerance / max(start, tolerance)) / math.log(damping)))
    for _ in range(max_iterations):
        scores = state.select("host", "trust", "distrust")
        down = edges.join(scores.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("down") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        up = edges.join(scores.withColumnRenamed("host", "dst"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("up") * F.col("distrust")).alias("d"))
        flow = down.unionAll(up).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new_trust = keep * F.col("trust_seed") + damping * F.coalesce("t", F.lit(0.0))
        new_distrust = keep * F.col("distrust_seed") + damping * F.coalesce("d", F.lit(0.0))
        moved = F.greatest(F.abs(new_trust - F.col("trust")), F.abs(new_distrust - F.col("distrust")))
        state = materialise(state.join(flow, "host", "left").select("host", "trust_seed", "distrust_seed", moved.alias("moved"), new_trust.alias("trust"), new_distrust.alias("distrust")), "host-trust")
        if state.agg(F.max("moved")).first()[0] <= tolerance:
            break
        state = state.drop("moved")
    else:
        raise RuntimeError(f"trust still moves by more than {tolerance} after {max_iterations} iterations")
    return state.select("host", "trust", "distrust")


def judge_pages(pages: DataFrame, rules: list[Rule], block_share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    A page that a rule fits has its verdict. A host's seeds are the shares of its pages that rules allow (trust) and block
    (distrust); what no rule fits is blocked where propagation leaves the host more distrust than trust by the threshold.
    A null url, or one without ://, has an empty host and path and is allowed. Null html has no links. Repeated rows are
    judged each; an empty table gives no rows. Only page_id, url and html are read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    share = lambda v: F.avg(F.when(F.col("_verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed"))
    scores = propagate(host_edges(pages), seeds)
    bad = F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > F.lit((1 - DAMPING) * block_share)
    verdict = F.coalesce(F.col("_verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
