"""URL filters: listed rules by host and path, then rules mined from labelled URLs.

For URLs that no listed rule fits, FP-growth finds combinations of URL tokens that go with bad labels;
those with enough bad pages and confidence are kept, smallest first (a rule whose part is a rule adds nothing),
and are looked up through an inverted index: each is posted under its rarest token, so a page meets only
rules of which it has that token, and then must have the rest.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflux.llm.common import let
from cityflux.plans.scratch import materialize, measured_side

# (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Bad pages a combination must be in, whatever the size of the crawl, and what share of those it is in must be bad.
PAGES = 25
CONFIDENCE = 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, f"{own}{start}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels with their places, path words, file ending, names of parameters, whether a fragment."""
    full = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    words = F.filter(F.split(path_of(url), r"[/._-]+"), lambda x: x != "")
    names = F.filter(F.regexp_extract_all(full, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.filter(F.array(F.concat(F.lit("scheme="), F.regexp_extract(full, r"(?s)^(.*?)://", 1))), lambda x: x != "scheme="),
            F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
            F.transform(words, lambda x: F.concat(F.lit("path="), x)),
            F.transform(names, lambda x: F.concat(F.lit("query="), x)),
            F.when(full.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, least: int = PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule: sorted tokens, confidence, support) from rows (url, bad); smallest combinations only.

    Null urls and null labels teach nothing. A rule is in ``least`` bad pages or more. Tokens that are rules alone are
    found by counting; FP-growth then works on the bad pages alone, without these tokens and those of fewer pages.
    """
    empty = labelled.sparkSession.createDataFrame([], "rule array<string>, confidence double, support double")
    known = labelled.filter(F.col("url").isNotNull() & F.col("bad").isNotNull())
    taken = materialize(known.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("t"), "bad"), "url-tokens")
    rows, bad_rows = taken.agg(F.count("*"), F.count_if("bad")).first()
    if bad_rows < least:
        return empty
    counted = taken.select("bad", F.explode("t").alias("token")).groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"))
    often = materialize(counted.filter(F.col("n_bad") >= least), "url-often")
    alone = F.col("n_bad") >= confidence * F.col("n")
    single = often.filter(alone).select(F.array("token").alias("rule"), "n_bad", "n")
    rest = measured_side(often.filter(~alone).select("token"), "url-rest")
    baskets = taken.filter("bad").select("row", F.explode("t").alias("token")).join(rest, "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = materialize(baskets, "url-baskets")
    # Half a page less: the share times the rows must not come out above the bound.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(baskets.count(), least)).fit(baskets)
    several = model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= least)).select(F.sort_array("items").alias("rule"), F.col("freq").alias("n_bad"))
    several = materialize(several, "url-sets")
    total = met(taken, several).groupBy("rule").agg(F.count("*").alias("n"))
    several = several.join(total, "rule").filter(F.col("n_bad") >= confidence * F.col("n"))
    found = single.unionByName(several.select("rule", "n_bad", "n"))
    rules = materialize(found.select("rule", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / rows).alias("support")), "url-rules")
    small, large = rules.alias("s"), rules.alias("l")
    # Parts of a rule that are rules: look each up among the sets of the rule's tokens less one or more.
    part = F.explode(F.filter(_subsets(F.col("l.rule")), lambda x: F.size(x) < F.size("l.rule")))
    beaten = rules.alias("l").select("l.rule", part.alias("part")).join(small.select(F.col("s.rule").alias("part")), "part").select("rule").distinct()
    return large.join(beaten, "rule", "left_anti")


def met(taken: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``taken`` (t: tokens) with each ``rule`` that fits, looked up under the rule's rarest token."""
    counts = taken.select(F.explode("t").alias("token")).join(measured_side(rules.select(F.explode("rule").alias("token")).distinct(), "rule-tokens"), "token").groupBy("token").count()
    entries = rules.select("rule", F.explode("rule").alias("token")).join(counts, "token")
    index = entries.groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token")).select("rule", "token")
    found = taken.select("*", F.explode("t").alias("token")).join(measured_side(index, "rule-index"), "token")
    return found.filter(F.forall("rule", lambda x: F.array_contains(F.col("t"), x)))


def _subsets(items: Column) -> Column:
    """All non-empty subsets of a short sorted array, each sorted."""
    start = F.array(F.array().cast("array<string>"))
    return F.filter(F.aggregate(items, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x))))), lambda s: F.size(s) > 0)


def matched(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` of pages (key, url) that some mined rule fits."""
    return met(pages.select(key, tokens(F.col("url")).alias("t")), rules).select(key).distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, least: int = PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``labelled`` has rows (url, bad). A null url, or one without ://, has an empty host and path, fits no
    rule and is allowed. Repeated rows and null page_ids are judged each. Equal urls get equal verdicts.
    Empty pages: no rows. Other columns are left out.
    """
    # Urls repeat; each distinct one is looked up once and joined back.
    named = pages.select("page_id", "url", F.xxhash64("url").alias("_url"))
    mined = measured_side(mine(labelled, least, confidence), "mined")
    host, path = F.col("host"), F.col("path")
    rule, verdict = listed(host, path, rules)
    split = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = split.withColumns({"rule": rule, "_listed": verdict})
    open_ = ruled.filter(F.col("rule").isNull() & F.col("url").isNotNull()).select("_url", "url").distinct()
    blocked = matched(open_, mined, "_url").withColumn("_blocked", F.lit(True))
    out = ruled.join(blocked, "_url", "left")
    final = F.coalesce(F.col("_listed"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))
