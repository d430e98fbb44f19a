"""URL filter: given host and path rules first, then association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that go together with unwanted pages; rules below the support or
the confidence are pruned, and so is a rule that a shorter one with at least its confidence covers. A rule is
filed under its rarest token, a URL looks its tokens up there, and the rule's other tokens are then verified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNWANTED = "unwanted"
#: A rule rests on so many labelled rows at least, however few there are.
LEAST_ROWS = 20
#: Rules (some 200 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The given rules.
HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)


def host(url: Column) -> Column:
    """From the first :// up to a slash, question mark or hash, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to a question mark or hash; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host_: Column, path_: Column, rules: tuple[HostRule, ...], value: str) -> Column:
    """A value (name or verdict) of the longest rule that fits; null if none does."""
    out: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))) if out is None else out.when(fits, F.lit(getattr(r, value)))
    return out if out is not None else F.lit(None).cast("string")


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens: scheme, host, its ending, words of its labels, first folder, extension, names in the query, fragment."""
    labels = F.split(host_, r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))
    words = F.transform(F.filter(F.split(host_, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    folder = F.regexp_extract(path_, r"(?s)^/([^/]*)/", 1)
    ending = F.regexp_extract(path_, r"\.([A-Za-z0-9]{1,5})$", 1)

    def named(kind: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{kind}="), value))

    single = F.array(
        named("scheme", F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        named("host", host_),
        named("domain", F.element_at(labels, -1)),
        named("folder", folder),
        named("ending", ending),
        F.when(path_.endswith("/"), F.lit("path ends in a slash")),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    return F.when(host_ != "", F.array_distinct(F.concat(F.array_compact(single), words, names))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """rule (sorted tokens), confidence, support, filed_under; from rows (tokens array, unwanted boolean)."""
    least = LEAST_ROWS / max(labelled.count(), LEAST_ROWS)
    baskets = labelled.select(F.when(F.col("unwanted"), F.concat("tokens", F.array(F.lit(UNWANTED)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, least), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == UNWANTED))
    rules = rules.select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    shorter = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("sure"), F.explode("rule").alias("token"))
    longer = rules.withColumn("token", F.explode("rule"))
    covered = longer.join(shorter, "token").where((F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0) & (F.col("sure") >= F.col("confidence"))).select("rule").distinct()
    rules = rules.join(covered, "rule", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq"))
    rarest = rules.withColumn("token", F.explode("rule")).join(single, "token").groupBy("rule").agg(F.min_by("token", F.struct("freq", "token")).alias("filed_under"))
    return rules.join(rarest, "rule")


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES, min_support: float = 0.005, min_confidence: float = 0.6, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict, sure (confidence of the mined rule, null if none) of every row.

    labelled: url, unwanted (boolean; rows with a null are left out). A URL that is null or has no :// has empty
    host and path, no tokens, and is allowed. Repeated rows are each judged. Tables may be empty: without
    labelled rows no rule is mined. Other columns are not looked at.
    """
    def parts(df: DataFrame, *keep: Column) -> DataFrame:
        df = df.select(*keep, F.col(url).alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
        return df.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))

    scratch = Scratch(pages.sparkSession, "url_rules")
    mined = scratch.save(mine(parts(labelled, F.col("unwanted")).where("unwanted is not null"), min_support, min_confidence), "rules")
    rows = parts(pages, F.col(page_id).cast("long").alias("page_id"))
    few = mined.count() <= BROADCAST_RULES
    index = mined.groupBy("filed_under").agg(F.collect_list(F.struct("rule", "confidence")).alias("rules"))  # rules of a token: as many as were mined, at most
    index = F.broadcast(index) if few else index
    # The tokens of the index only: a token that no rule is filed under, such as a scheme, meets nothing.
    known = scratch.save(mined.select(F.col("filed_under").alias("token")).distinct(), "tokens")
    urls = rows.select("url", "tokens", F.explode("tokens").alias("filed_under"))
    urls = urls.join(F.broadcast(known) if few else known, F.col("filed_under") == F.col("token"), "left_semi")
    looked_up = urls.join(index, "filed_under").select("url", "tokens", F.explode("rules").alias("r"))
    hits = looked_up.where(F.size(F.array_except("r.rule", "tokens")) == 0).groupBy("url").agg(F.max("r.confidence").alias("sure"))
    given = fitting(F.col("host"), F.col("path"), rules, "verdict")
    return rows.join(hits, "url", "left").select(
        "page_id",
        "host",
        "path",
        fitting(F.col("host"), F.col("path"), rules, "name").alias("rule"),
        F.coalesce(given, F.when(F.col("sure").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "sure",
    )
