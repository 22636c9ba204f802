"""URL filters: pattern rules indexed by their rarest literal token.

A rule is stored under that of its literal tokens which the fewest urls have. The tokens of a url
fetch the rules it may fit, and only those are tried: host and subdomains, start of the path, and a
regular expression where the rule has one. The longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table

# A rule set is broadcast up to this many rules, beyond it is joined by a shuffle.
BROADCAST_RULES = 100_000

# The stated rules (verdict, host, start of path), and expressions for urls that
# none of them fits (verdict, literal text of the expression, expression over host and path).
STATED = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
EXPRESSIONS = [
    ("block", "adult", r"(^|[.-])adult[.-]"), ("block", "casino", r"(^|[./-])casino([./-]|$)"),
    ("block", "porn", r"(^|[./-])porn([./-]|$)"), ("block", "xxx", r"(^|[.-])xxx([.-]|$)"),
    ("block", "warez", r"(^|[./-])warez([./-]|$)"), ("block", "betting", r"(^|[./-])betting([./-]|$)"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit("")))


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def rule_table(spark: SparkSession) -> DataFrame:
    """rule, verdict, host, path, literals (tokens that a fitting url must have), expression."""
    rows = [(h + p, v, h, p, None) for v, h, p in STATED]
    rows += [(f"~{e}", v, None, None, e) for v, _, e in EXPRESSIONS]
    texts = {f"~{e}": t for _, t, e in EXPRESSIONS}
    frame = spark.createDataFrame(
        [(*r, texts.get(r[0], r[2] or "")) for r in rows],
        "rule string, verdict string, host string, path string, expression string, literal string")
    # The start of a path may end inside a token, so that only whole tokens of it are literals.
    whole = F.regexp_replace(F.coalesce("path", F.lit("")), r"[\p{L}\p{N}]+$", "")
    return frame.select("rule", "verdict", "host", "path", "expression",
                        tokens(F.concat_ws("/", "literal", whole)).alias("literals"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Each distinct url with host, path, the stated rule that decides (else null) and the verdict.

    Stated rules (with a host) go before expressions; among stated ones the longest text wins, then
    block over allow, then the smaller text; among expressions block wins. Null urls and urls
    without ``://`` have an empty host and path and get the default verdict. Other columns are
    dropped.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("url_host"), path.alias("url_path"))
    words = urls.select("url", "url_host", "url_path",
                        F.explode(tokens(F.concat_ws("/", "url_host", "url_path"))).alias("token"))
    options = rules.select("rule", F.explode("literals").alias("token"))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    counts = words.join(near(options.select("token").distinct()), "token").groupBy("token").count()
    rarest = options.join(near(counts) if small else counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rules.join(rarest, "rule").select(F.col("r.token").alias("token"), "rule", "verdict", "host", "path", "expression")
    c = words.join(near(index), "token")
    fits_host = (F.col("url_host") == F.col("host")) | F.endswith("url_host", F.concat(F.lit("."), F.col("host")))
    stated = F.col("host").isNotNull() & fits_host & F.startswith("url_path", F.col("path"))
    by_text = F.col("expression").isNotNull() & F.regexp_like(
        F.concat("url_host", "url_path"), F.coalesce("expression", F.lit("^$")))
    rank = F.struct(
        F.col("host").isNotNull().alias("stated"), F.when(F.col("host").isNotNull(), F.length("rule")).alias("size"),
        (F.col("verdict") == "block").alias("block"))
    best = c.where(stated | by_text).groupBy("url").agg(
        F.max(F.struct(rank.alias("rank"), "verdict")).alias("best"),
        F.max(F.when(F.col("host").isNotNull(), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"),
                                                         F.col("rule").alias("rule")))).alias("top"))
    return urls.join(best, "url", "left").select(
        "url", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("top.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. Rows with equal urls are judged once
    and each gets the verdict; null page ids are kept."""
    judged = judge(pages, rules)
    host, path = parts(F.lit(None).cast("string"))
    return pages.select("page_id", "url").join(judged, "url", "left").select(
        "page_id", F.coalesce("host", host).alias("host"), F.coalesce("path", path).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


@query("op4_url_filter", r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/'))
SELECT h.page_id, h.host, h.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
  coalesce(max_by(verdict, length(rhost || rpath)),
    CASE WHEN regexp_matches(h.host || h.path, '(^|[.-])adult[.-]|(^|[./-])(casino|porn|warez|betting)([./-]|$)|(^|[.-])xxx([.-]|$)')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
GROUP BY h.page_id, h.host, h.path
""")
def op4_url_filter(spark, sf_dir):
    return filter_pages(table(spark, sf_dir, "pages"), rule_table(spark))
