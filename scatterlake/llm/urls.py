"""URL filters: rules by host and path, and link-graph propagation where none fits.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins. Hosts most of whose pages are allowed by rules are trusted
seeds, hosts most of whose pages are blocked are blocked seeds. Trust is the
personalised PageRank of the trusted seeds along links between hosts; distrust
is that of the blocked seeds against the links: who links to the blocked is
doubted. Both are summed as the power series sum((1 - d) * d**k * s * W**k), a
join and an aggregate a step over links counted by pair of hosts, until nothing
is left to pass on or, after ``STEPS`` steps, less than 1e-6 of the mass: only a
host whose distrust is that close to its bound could be judged otherwise. A page without
a rule is blocked if its host's distrust is over ``RATIO`` times its trust.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end. Defined results: a null url, or one without
``://``, has an empty host and path; hosts without evidence are allowed; links within
a host, without a host and from null html don't count; repeated rows count as
often as they stand there; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm.tables import checkpoint, join_counted, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, STEPS, RATIO, CUT = 0.85, 90, 1.0, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def ruled(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from host to host, counted."""
    found = pages.where("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    return found.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, start: str, end: str) -> DataFrame:
    """(host, mass): personalised PageRank of the seeds along links from ``start`` to ``end``."""
    total = seeds.count()
    mass = seeds.select("host", F.lit((1 - DAMPING) / max(1, total)).alias("m"))
    out = links.groupBy(start).agg(F.sum("n").alias("all"))
    step = checkpoint(links.join(out, start).select(F.col(start).alias("a"), F.col(end).alias("b"), (DAMPING * F.col("n") / F.col("all")).alias("w")))
    whole = mass
    if total and not step.isEmpty():
        for k in range(STEPS):
            mass = mass.join(step, F.col("host") == F.col("a")).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("m") * F.col("w")).alias("m"))
            if k % CUT == CUT - 1:
                mass = checkpoint(mass)
                if mass.isEmpty():
                    break
            whole = whole.unionByName(mass)
    return checkpoint(whole.groupBy("host").agg(F.sum("m").alias("mass")))


def judged(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row."""
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    known = placed.withColumn("rule", rule).withColumn("own", verdict)
    count = lambda kind: F.count(F.when(F.col("own") == kind, 1))
    every = checkpoint(known.groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("allowed"), count("block").alias("blocked")))
    hosts = every.where("host != ''")
    links = checkpoint(host_links(pages))
    trust = spread(links, hosts.where("allowed > blocked and 2 * allowed > n"), "src", "dst").withColumnRenamed("mass", "trust")
    doubt = spread(links, hosts.where("blocked > allowed and 2 * blocked > n"), "dst", "src").withColumnRenamed("mass", "distrust")
    scored = checkpoint(every.select("host", "n").join(trust, "host", "left").join(doubt, "host", "left").na.fill(0.0))
    return join_counted(known, scored, "host", "n").select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(k, h, p)}'" for k, h, p in ordered) + " END"
    walk = lambda name, seeds, a, b: f"""{name}_seed AS (SELECT host FROM hosts WHERE {seeds}),
{name}_step AS (SELECT {a} AS a, {b} AS b, {DAMPING} * n / sum(n) OVER (PARTITION BY {a}) AS w FROM links),
{name}_walk AS (
  SELECT 0 AS k, host, {1 - DAMPING} / (SELECT count(*) FROM {name}_seed) AS m FROM {name}_seed
  UNION ALL
  SELECT k + 1, b, sum(m * w) FROM {name}_walk JOIN {name}_step ON host = a WHERE k < {STEPS} GROUP BY k, b
),
{name} AS (SELECT host, sum(m) AS mass FROM {name}_walk GROUP BY host)"""  # noqa: E731
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE placed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path, html FROM pages
), known AS (
  SELECT *, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS own FROM placed
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (own = 'allow') AS allowed, count(*) FILTER (own = 'block') AS blocked FROM known WHERE host <> '' GROUP BY host
), links AS (
  SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM placed)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), {walk("trust", "allowed > blocked AND 2 * allowed > n", "src", "dst")},
{walk("doubt", "blocked > allowed AND 2 * blocked > n", "dst", "src")}
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN coalesce(doubt.mass, 0) > {RATIO} * coalesce(trust.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM known LEFT JOIN trust USING (host) LEFT JOIN doubt USING (host)
"""


ORACLE = _oracle()
