"""URL filtering by a rule list and by association rules, with DataFrame functions only.

Lists judge first: a rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's; the longest fits best. Other urls are judged by rules that FP-growth mines from
labelled urls: combinations of url tokens that imply ``block`` with enough support and
confidence. Mined rules are matched by an inverted index from token to rule: a rule fires when as
many of its tokens are found as it has.

Edge cases: a null url, or one without ``://``, has an empty host and path, no tokens and the
default verdict; repeated rows are judged each; without a url to block nothing is mined; an empty table
gives an empty result; other columns are kept except those named host, path, rule, verdict.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
LEAST_SUPPORT = 0.002
LEAST_CONFIDENCE = 0.8
#: Words of host names that label a url for mining where no list or label does.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as a struct of rule and verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host words and endings, path segments without digits, query keys, scheme, file ending."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host"), k.cast("string"), F.lit("="), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")))
    levels = F.when(host != "", ends).otherwise(F.array().cast("array<string>"))
    first = F.when((F.size(labels) >= 2) & (host != ""), F.concat(F.lit("first="), F.element_at(labels, 1)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x, i: F.concat(F.lit("seg"), (i + 1).cast("string"), F.lit("="), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    words = F.transform(F.filter(F.split(host, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    scheme = F.when(F.instr(url, "://") > 0, F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    ending = F.nullif(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1), F.lit(""))
    own = F.concat(words, levels, segments, F.array(first, scheme, F.concat(F.lit("ending="), ending)), keys)
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(own, F.array().cast("array<string>")))))


def _counted(rows: DataFrame) -> DataFrame:
    """Of each token: the rows that hold it, those of them to block, and two hashes of the token sets that hold it."""
    each = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"))
    each = each.withColumns({"h1": F.xxhash64(F.lit(1), "tokens"), "h2": F.xxhash64(F.lit(2), "tokens")})
    each = each.select(F.explode("tokens").alias("token"), "n", "bad", "h1", "h2")
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, confidence, support) that imply ``verdict=block``, from tokens and verdict columns.

    A rule is kept if no rule on fewer of its tokens is as confident. So tokens in too few rows to
    block, and those that imply ``block`` alone, needn't be combined with others; of tokens that
    always stand together one is combined, and its rules are repeated with each of the others.
    """
    target = "verdict=block"
    rows = labelled.where("verdict is not null").select("tokens", "verdict")
    total, bad = rows.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    # As Spark counts: the support asked for, in rows.
    often = _counted(rows).where((F.col("bad") > 0) & (F.col("bad") >= F.ceil(F.lit(support) * total)))
    alike = often.groupBy("h1", "h2", "n", "bad").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("same"))
    sure = alike.where((F.col("n") == F.col("bad")) & F.lit(bad < total)).select(F.explode("same").alias("token"), (F.col("bad") / F.lit(total)).alias("support"))
    sure = sure.select(F.array("token").alias("antecedent"), F.lit(1.0).alias("confidence"), "support")
    open_ = alike.where("n > bad").select("token", "same")
    held = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(open_.select("token"), "token")
    held = held.groupBy("tokens").agg(F.collect_list("token").alias("combined"))
    none = F.array().cast("array<string>")
    items = rows.join(held, "tokens", "left").select(F.concat(F.coalesce("combined", none), F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0] == target)
    found = found.where(F.col("lift") > 1).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    found = found.where(~F.exists("antecedent", lambda x: F.startswith(x, F.lit("verdict="))))
    # A shorter rule shares its first token with each rule that holds it: an equi-join on a token, not of all pairs.
    heads = found.select(F.col("antecedent").alias("fewer"), F.col("confidence").alias("as_good"), F.element_at("antecedent", 1).alias("token"))
    each = found.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    beaten = each.join(heads, "token").where((F.size("fewer") < F.size("antecedent")) & (F.size(F.array_except("fewer", "antecedent")) == 0) & (F.col("as_good") >= F.col("confidence")))
    found = found.join(beaten.select("antecedent").distinct(), "antecedent", "left_anti")
    ways = found.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(open_, "token").groupBy("antecedent", "confidence", "support").agg(F.collect_list("same").alias("ways"))
    each = F.aggregate("ways", F.array(none), lambda had, more: F.flatten(F.transform(had, lambda x: F.transform(more, lambda y: F.concat(x, F.array(y))))))
    return ways.select(F.explode(each).alias("antecedent"), "confidence", "support").select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support").unionByName(sure)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct token set its most confident fired rule: tokens, fired, confidence."""
    index = rules.select(F.array_join("antecedent", " & ").alias("fired"), F.size("antecedent").alias("need"), "confidence", F.explode("antecedent").alias("token"))
    sets = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    hits = sets.join(index, "token").groupBy("tokens", "fired", "need", "confidence").count().where(F.col("count") == F.col("need"))
    return hits.groupBy("tokens").agg(F.min(F.struct(-F.col("confidence"), -F.col("need"), "fired")).alias("best")).select("tokens", F.col("best.fired").alias("fired"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, default: str = DEFAULT, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """All columns of pages with host, path, rule, verdict, and ``fired``, the mined rule that blocks.

    labelled has url and verdict (block or allow). ``block`` for a host with a seed word counts as
    a label too; the list's verdicts don't, as they would spread from listed hosts to all others.
    Without labelled urls, or with an empty table of them, those without a seed word count as
    ``allow`` unless the list blocks them.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "fired")]
    if labelled is not None and labelled.isEmpty():
        labelled = None

    def read(df: DataFrame) -> DataFrame:
        host, path = parse(F.col("url"))
        df = df.withColumns({"host": host, "path": path})
        return df.withColumns({"listed": listed(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})

    seen = read(pages.select(kept))
    seeded = F.when(F.arrays_overlap("tokens", F.array(*(F.lit(f"word={w}") for w in SEEDS))), "block")
    unlabelled = F.when(F.coalesce(F.col("listed.verdict") != "block", F.lit(True)), "allow")
    known = seen.select("tokens", (seeded if labelled is not None else F.coalesce(seeded, unlabelled)).alias("verdict"))
    if labelled is not None:
        own = read(labelled.select("url", F.col("verdict").alias("said")))
        known = known.where("verdict is not null").unionByName(own.select("tokens", F.coalesce(seeded, "said").alias("verdict")))
    fired = match(seen.where("listed is null"), mine(known.select("tokens", "verdict"), support, confidence))
    out = seen.join(fired, "tokens", "left")
    mined = F.when(F.col("fired").isNotNull(), "block").otherwise(default)
    return out.select(*kept, "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", mined).alias("verdict"), F.when(F.col("listed").isNull(), F.col("fired")).alias("fired"))
