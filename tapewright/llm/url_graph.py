"""URL filter by rules and by link-graph propagation over hosts. DataFrame operations only.

Trust spreads from trusted hosts along links, as personalised PageRank; distrust spreads from blocked hosts against the
links, to the hosts that point at them: each takes the mean over the hosts that it links to, so its distrust is the same
however many others point there. A host whose distrust outweighs its trust by a threshold is blocked; a rule that fits a
url decides before that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_spread, written

DAMPING, ROUNDS = 0.85, 20
#: A seed without links has 1 - DAMPING.
LIMIT = 0.1
#: A host is a seed if rules decide this share of its pages one way.
SEED_SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, with A-Z lower-cased; empty without :// and for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// and for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits (ties: the later in the alphabet), or null.

    A rule is ("allow" or "block", host followed by the path's beginning); it holds for the host and its subdomains.
    """

    def one(verdict: str, rule: str) -> Column:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        return F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.array_max(F.array(*[one(v, r) for v, r in rules])) if rules else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: distinct links between different hosts, from the href attributes of pages.html with a host in them."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]*)"), F.lit(1))
    found = pages.select(host(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    named = found.select("src", host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return named.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, split: str = "src") -> DataFrame:
    """host, score: personalised PageRank with `seeds` (host, weight) as where walks begin; (1 - damping) x weight stays with a seed.

    A host without outgoing links passes nothing on. A score is split among a host's outgoing links; with split="dst" a
    host takes the mean of its incoming ones instead. Written out every fifth round, so that lineage stays short.
    """
    start = seeds.select("host", ((1 - damping) * F.col("weight")).alias("score"))
    shares = written(edges.join(edges.groupBy(split).agg(F.count("*").alias("n")), split).select("src", "dst", (damping / F.col("n")).alias("share")))
    now = start
    for i in range(rounds):
        sent = now.join(shares, now["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        now = start.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score"))
        if i % 5 == 4:
            now = written(now)
    return now


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, distrust_split: str = "src") -> DataFrame:
    """host, trust, distrust. seeds: host, trusted and blocked (double weights, 0 or null: none). Without any edge the seeds keep their own.

    With distrust_split="dst" a host's distrust is the mean over the hosts that it links to, whatever links there besides.
    """
    edges = written(edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = []
    linked = not edges.isEmpty()
    for name, weight, links, split in (("trust", "trusted", edges, "src"), ("distrust", "blocked", back, distrust_split)):
        own = seeds.where(F.col(weight) > 0).select("host", F.col(weight).alias("weight"))
        score = propagate(own, links, damping, rounds, split) if linked else own.select("host", ((1 - damping) * F.col("weight")).alias("score"))
        parts.append(score.select("host", *[(F.col("score") if name == x else F.lit(0.0)).alias(x) for x in ("trust", "distrust")]))
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, seed_share: float = SEED_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages (page_id, url, html).

    Seeds: hosts of which the rules allow (trusted) or block (blocked) at least seed_share of the pages. Without a rule
    a url is blocked if its host's distrust less its trust is `limit` or more, else allowed; an empty host is allowed.
    Null urls have an empty host and path; null html has no links; repeated rows each stay and count; an empty table gives
    no row; other columns are left out. Scores are broadcast if they are small, else hosts of many pages are spread.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg((F.coalesce(F.col("fit.verdict"), F.lit("")) == v).cast("double"))
    hosts = written(ruled.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), share("allow").alias("allowed"), share("block").alias("blocked")))
    weight = lambda c: F.when(F.col(c) >= seed_share, 1.0).otherwise(0.0)
    seeds = hosts.select("host", weight("allowed").alias("trusted"), weight("blocked").alias("blocked"))
    scores = written(host_scores(seeds, host_edges(pages), distrust_split="dst").join(hosts.select("host", "n"), "host"))
    joined = join_spread(ruled, scores, "host", "n", F.length("host") + 32, "page_id")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(distrust - trust >= limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_graph).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))


def sql(rules: list[tuple[str, str]], limit: float = LIMIT, seed_share: float = SEED_SHARE, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """The same over a view `pages` in DuckDB's SQL, one CTE for each round of propagation."""
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    longest = sorted(rules, key=lambda r: (len(r[1]), r[1], r[0]), reverse=True)
    case = lambda values: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{x}'" for (_, r), x in zip(longest, values, strict=True)) + " END"
    named = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    ctes = [
        f"parts AS (SELECT page_id, html, {named("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"ruled AS (SELECT *, {case([r for _, r in longest])} AS rule, {case([v for v, _ in longest])} AS fixed FROM parts)",
        f"seeds AS (SELECT host, avg(CAST(coalesce(fixed, '') = 'allow' AS DOUBLE)) >= {seed_share} AS trusted, avg(CAST(coalesce(fixed, '') = 'block' AS DOUBLE)) >= {seed_share} AS blocked FROM ruled WHERE host <> '' GROUP BY host)",
        r"""links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''>]*)', 1)) AS link FROM parts)""",
        f"edges AS (SELECT DISTINCT src, dst FROM (SELECT src, {named("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links) WHERE src <> '' AND dst <> '' AND src <> dst)",
    ]
    # trust is split among a host's links; distrust, against the links, is the mean over the hosts that a host links to
    for name, seed, a, b in (("trust", "trusted", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        ctes.append(f"{name}0 AS (SELECT host, {1 - damping}::DOUBLE AS score FROM seeds WHERE {seed})")
        for i in range(1, rounds + 1):
            sent = f"SELECT e.{b} AS host, p.score * {damping} / d.n AS score FROM {name}{i - 1} p JOIN edges e ON e.{a} = p.host JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) d ON d.src = e.src"
            ctes.append(f"{name}{i} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}0 UNION ALL {sent}) GROUP BY host)")
    trust, distrust = "coalesce(t.score, 0)", "coalesce(d.score, 0)"
    return f"""WITH {", ".join(ctes)} SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN {distrust} - {trust} >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, round({trust}, 9) AS trust, round({distrust}, 9) AS distrust
FROM ruled LEFT JOIN trust{rounds} t USING (host) LEFT JOIN distrust{rounds} d USING (host)"""
