"""URL filters: fixed host and path rules, and association rules over URL tokens mined by FP-growth.

A url is a set of tokens: scheme, host labels, path segments (digits as #), query keys, fragment.
Labelled urls are transactions of their tokens and their label; FP-growth finds the frequent
combinations, and rules that end in the label are kept by support and confidence (the lower end of
its Wilson interval, so few urls alone are no evidence), and only if no rule of fewer tokens among
them is as confident. Each kept rule is indexed under its rarest token;
a url meets only the rules of its own tokens, and a rule fires if the url has all of its tokens.

Everything is built-in functions, joins and Spark's own FP-growth.

Defined results: a null url or one without ``://`` has an empty host and path and no tokens; it is
allowed. Repeated rows are judged alike; urls without label are no transactions; without any
labelled url there is no mined rule. Extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import with_results

#: (verdict, host, path): a rule holds for its host and all subdomains, below its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT = 0.001
CONFIDENCE = 0.5
#: Deviations of the interval around a rule's confidence; its lower end has to reach the limit, at any size of the table.
Z = 1.96
BLOCK = "=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(url: Column) -> Column:
    """The distinct tokens of a url."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    parts = [
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(u, "://", 1)))),
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
        F.when(F.instr(u, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(F.instr(u, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def label_key(url: Column) -> Column:
    """The document that a page shows: the number that its path's last segment begins with."""
    return F.regexp_extract(host_and_path(url)[1], r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long")


def least_sure(share: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of a share among ``n``."""
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(anchor, antecedent, confidence, support) of the kept rules, from urls with a boolean label."""
    label = F.when(F.col(bad), F.lit(BLOCK)).otherwise("=allow")
    sets = labelled.where(F.col(bad).isNotNull()).select(tokens(F.col(url)).alias("items"), label.alias("label")).where("size(items) > 0")
    baskets = sets.select(F.concat("items", F.array("label")).alias("items"))
    # with fewer urls than that, all of them bad, the lower end lies under the limit: no rule is lost by not looking
    evidence = Z * Z * confidence / max(1 - confidence, 1e-9)
    total = max(1, baskets.count())
    share = min(1.0, max(support, math.floor(evidence) / total))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    one = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), F.col("freq"))
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK).where("lift > 1")
    rules = rules.where(least_sure(F.col("confidence"), F.col("support") * total / F.col("confidence")) >= confidence).select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support")
    # The rarest token of a rule is its place in the index.
    places = rules.withColumn("token", F.explode("antecedent")).join(one, "token").groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    inner = places.select("anchor", F.col("antecedent").alias("less"), F.col("confidence").alias("sure"))
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("anchor"))
    beaten = wide.join(inner, "anchor").where((F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence"))).select("antecedent").distinct()
    return places.join(beaten, "antecedent", "left_anti").select("anchor", "antecedent", "confidence", "support")


def fired(pages: DataFrame, mined: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence, antecedent) of the surest rule of each distinct url that any rule fires on."""
    own = pages.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    met = own.withColumn("anchor", F.explode("tokens")).join(mined, "anchor").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "antecedent"))
    return met.groupBy("url").agg(best.alias("b")).select("url", "b.confidence", "b.antecedent")


def judge(pages: DataFrame, mined: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict."""
    host, path = host_and_path(F.col(url))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Compiled into one expression, the longest rule outermost.
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    hits = fired(pages, mined, url).select(F.col("url").alias("__url"), F.lit(True).alias("__hit"))
    joined = pages.join(hits, F.col(url) == F.col("__url"), "left")
    method = F.when(F.col("__hit"), F.lit("block")).otherwise("allow")
    return with_results(joined, {"host": host, "path": path, "rule": rule, "verdict": F.coalesce(verdict, method)}).drop("__url", "__hit")
