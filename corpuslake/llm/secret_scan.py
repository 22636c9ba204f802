"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by the sha256 of its content. The ledger holds which rules
(kind and version) have been run on which blob, and what they found; a scan runs only the pairs
that are missing, once per blob, and joins the findings back to all paths with that content.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.session import shared_base

SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost first and not overlapping; those whose ``group`` has
    fewer than ``least`` characters are dropped. ``needs`` is a cheap test of the whole text that
    every match passes. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int
    least: int
    needs: str | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules, then those that this operator adds. A run of hex digits is
# looked for with its least length at once: runs are maximal, so no other match is lost.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)
# A key runs to its END line, before any other BEGIN; without one, over what follows of its headers
# and base64: runs of 16 characters and more, short ones that are padded or end a line, and one more
# short run after a long one.
KEY_GAP = r"""(?:[\s>|#*]|\\[nrt]?|["'][\s,+.\\]*+["'])"""
KEY_BODY = (
    rf"(?:{KEY_GAP}*+(?:(?:Proc-Type|DEK-Info):[\x20\t]*+\S++|[A-Za-z0-9+/]{{16,}}+=*+|[A-Za-z0-9+/]++=++|"
    r"""[A-Za-z0-9+/]++(?=[\x20\t]*+(?:$|[\r\n"']|\\[nr]))))*+"""
    rf"(?:(?<=[A-Za-z0-9+/]{{16}}){KEY_GAP}++[A-Za-z0-9+/]++)?+"
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END)\x20))*+-----END [A-Z ]*PRIVATE KEY-----|"
         + KEY_BODY + ")", 0, 1, "PRIVATE KEY-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, "eyJ"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}=*", 0, 20, "Bearer "),
    Rule("forge", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 20, "_"),
    # The user may be empty; a password goes on to the last @ of its word.
    Rule("userinfo", r"""(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]++://[^\s/:@]*+:[^\s/@]{3,}+@(?:[^\s/:@"'<>,;&|]++@)*+""",
         0, 8, "@", version=2),
)
RULES = BASE + ADDED


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in code points, end exclusive. Splitting by the pattern gives what lies
    between the matches, and so their places."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    long_enough = (lambda m: F.length(m) >= rule.least) if rule.group == 0 else (
        lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
    gaps = F.split(text, rule.pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("at"),
            F.when(long_enough(x["m"]), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["g"])).cast("int").alias("start"),
                F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"),
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("end"),
            )))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    found = text.rlike(rule.pattern)
    if rule.needs:
        found = F.contains(text, F.lit(rule.needs)) & found
    return F.when(found, placed).otherwise(F.array().cast(SPAN))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(
    versions: DataFrame, ledger_path: str, key: str = "doc_id", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Bring the ledger up to date with ``versions`` (columns ``key``, text) and give each row its
    findings: ``key``, blob, spans.

    A null text is the empty blob, which has no findings; rows with a null key take part like
    others. Equal texts share one blob and one scan. The ledger only grows: every scan adds a folder
    of its own, so that scans may run side by side, and a scan that died leaves pairs that the next
    one runs. Other columns are dropped.
    """
    spark = versions.sparkSession
    versions = versions.select(F.col(key).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    paths = versions.select("path", blob_of(F.col("text")).alias("blob"))
    names = F.array(*[F.lit(r.name) for r in rules])

    ledger = _ledger(spark, ledger_path)
    seen = None if ledger is None else ledger.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
    leads = paths.groupBy("blob").agg(F.min(F.struct("path")).alias("lead"))
    if seen is None:
        leads = leads.select("blob", F.col("lead.path").alias("path"), names.alias("missing"))
    else:
        leads = leads.join(seen, "blob", "left").select(
            "blob", F.col("lead.path").alias("path"),
            F.array_except(names, F.coalesce("rules", F.array().cast("array<string>"))).alias("missing"),
        ).where(F.size("missing") > 0)
    # Only small rows are hashed; the texts stream past them.
    todo = versions.alias("v").join(
        leads.hint("shuffle_hash"),
        F.col("v.path").eqNullSafe(leads["path"]) & (blob_of(F.col("v.text")) == leads["blob"]),
    ).select("blob", "missing", "v.text")
    text = F.col("text")
    parts = [F.when(F.array_contains("missing", r.name), spans_of(text, r, i)).otherwise(
        F.array().cast(SPAN)) for i, r in enumerate(rules)]
    todo.select("blob", F.col("missing").alias("rules"), F.concat(*parts).alias("spans")).write.parquet(
        f"{ledger_path}/run=r{uuid.uuid4().hex}")

    # A rule's spans count only from the version asked for.
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
    entries = _ledger(spark, ledger_path).select(
        "blob", F.filter("spans", lambda s: F.array_contains(F.col("rules"), kinds[s["kind"]])).alias("spans"))
    found = entries.where(F.size("spans") > 0).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths.join(found, "blob", "left").select(
        F.col("path").alias(key), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _ledger(spark, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path).select("blob", "rules", "spans")


def add_unseen(spark, own: str, ledger: str) -> None:
    """Add the pairs of a scan's own ledger to another one, as far as that lacks them."""
    pairs, known = _ledger(spark, own), _ledger(spark, ledger)
    if known is not None:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(
            F.collect_set("rule").alias("seen"))
        pairs = pairs.join(seen, "blob", "left").withColumn("rules", F.array_except(
            "rules", F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0).drop("seen")
    pairs.write.parquet(f"{ledger}/run=r{uuid.uuid4().hex}")


def shared_ledger(spark) -> str:
    """The ledger of this library's rules in the shared folder: blobs that any earlier run has scanned are
    not scanned again."""
    return f"{shared_base(spark)}/secret-ledger"


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced once, up to the last end."""
    cut = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"], F.struct(
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"),
                s["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text))))


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, shared_ledger(spark))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}")
              for r in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("spans")).alias("spans"))
