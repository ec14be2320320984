"""URL filters by a path-template tree per host, in DataFrame functions only.

Rules judge first; what they judge is the labelled part of the pages. Per host, the
paths form a tree whose variable segments become wildcards: numbers and hashes by their
form, other segments where a branch has many different rare ones. Sibling templates
whose labels do not differ statistically are merged, and a template whose smoothed
labelled purity is high is rejected, with every page of it that no rule judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import pinned
from pairloom.operators.joins import lookup_join

# The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

LEVELS = 6  # deeper segments form one last wildcard
MANY_BRANCHES, RARE_PAGES = 20, 5
LEAST_LABELS, PRIOR_WEIGHT, PURE = 5, 4.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or a url without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        text, verdict = F.when(fits, of_host + of_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _typed(segment: Column) -> Column:
    """Numbers and hashes as wildcards of their form."""
    number = F.regexp_replace(segment, r"^[0-9]+(\.[a-z]+)?$", "{n}$1")
    return F.when(segment.rlike(r"^(?=.*[0-9])[0-9a-f-]{8,}$") & ~segment.rlike("^[0-9]+$"), "{h}").otherwise(number)


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (``host``, ``path``, ``pages``, ...) with ``template`` and its ``parent``, level by level down the tree."""
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _typed)
    rows = pinned(paths.withColumn("_segments", segments).withColumn("template", F.lit("")).withColumn("parent", F.lit("")))
    depth = rows.agg(F.coalesce(F.max(F.size("_segments")), F.lit(0))).first()[0]
    for level in range(min(depth, LEVELS)):
        rows = rows.withColumn("_segment", F.get("_segments", F.lit(level)))
        branches = rows.where("_segment is not null").groupBy("host", "template", "_segment").agg(F.sum("pages").alias("_pages"))
        # Rare branches where there are many: known from the counts, one row per branch.
        wide = branches.groupBy("host", "template").agg(F.count("*").alias("_branches")).where(F.col("_branches") > MANY_BRANCHES)
        rare = branches.where(F.col("_pages") < RARE_PAGES).join(wide, ["host", "template"]).select("host", "template", "_segment", F.lit(True).alias("_rare"))
        rows = lookup_join(rows, pinned(rare), ["host", "template", "_segment"], "left", spread_by=["path"])
        name = F.when(F.col("_rare"), "*").otherwise(F.col("_segment"))
        deeper = F.col("_segment").isNotNull()
        grown = F.when(deeper, F.concat("template", F.lit("/"), name)).otherwise(F.col("template"))
        rows = pinned(rows.withColumn("parent", F.when(deeper, F.col("template")).otherwise(F.col("parent"))).withColumn("template", grown).drop("_rare", "_segment"))
    beyond = F.size("_segments") > LEVELS
    rows = rows.withColumn("parent", F.when(beyond, F.col("template")).otherwise(F.col("parent"))).withColumn("template", F.when(beyond, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    return rows.drop("_segments")


def merged(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``host``, ``parent``, ``template``, ``bad``, ``good``) with ``branch``: one name for siblings with like labels.

    A sibling is like the others if its bad labels lie within two standard deviations
    of what the rate of all labelled siblings makes likely.
    """
    labelled = leaves.where(F.col("bad") + F.col("good") >= LEAST_LABELS)
    pool = labelled.groupBy("host", "parent").agg((F.sum("bad") / F.sum(F.col("bad") + F.col("good"))).alias("rate"), F.count("*").alias("n")).where("n > 1")
    number = (F.col("bad") + F.col("good")).cast("double")
    gap = F.col("bad") - number * F.col("rate")
    like = labelled.join(pool, ["host", "parent"]).where(gap * gap <= 4 * number * F.col("rate") * (1 - F.col("rate")))
    names = like.select("host", "template", F.concat("parent", F.lit("/{~}")).alias("_branch"))
    return leaves.join(names, ["host", "template"], "left").withColumn("branch", F.coalesce("_branch", "template")).drop("_branch")


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``template`` of each page.

    A page that a rule fits has the rule's verdict, any other that of its template:
    ``block`` if rejected, else ``allow``. A null url counts as an empty one; repeated
    rows repeat; a null key stays null; other columns are ignored; an empty table gives
    an empty result. Paths are counted before they are shuffled, so a hot host or a
    path of many pages is one row each.
    """
    host, path = host_and_path(pages[url])
    base = pages.select(pages[key].alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("by_rule", verdict)
    counts = [F.count("*").alias("pages")] + [F.count_if(F.col("by_rule") == kind).alias(name) for kind, name in (("block", "bad"), ("allow", "good"))]
    placed = pinned(templates(base.groupBy("host", "path").agg(*counts)))
    leaves = placed.groupBy("host", "parent", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    named = pinned(merged(leaves))
    bad, good = named.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = bad / (bad + good) if bad + good else 0.0
    number = F.col("bad") + F.col("good")
    purity = (F.col("bad") + PRIOR_WEIGHT * prior) / (number + PRIOR_WEIGHT)
    branches = named.groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select("host", "branch", ((number >= LEAST_LABELS) & (purity >= PURE)).alias("rejected"))
    judged = named.select("host", "template", "branch").join(branches, ["host", "branch"])
    of_path = lookup_join(placed.select("host", "path", "template"), pinned(judged), ["host", "template"], spread_by=["path"]).select("host", "path", "template", "rejected")
    found = lookup_join(base, pinned(of_path), ["host", "path"], "left", spread_by=["key"])
    final = F.coalesce("by_rule", F.when(F.col("rejected"), "block").otherwise("allow"))
    return found.select(F.col("key").alias(key), "host", "path", "rule", final.alias("verdict"), "template")
