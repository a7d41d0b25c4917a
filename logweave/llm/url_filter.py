"""URL filters: host-suffix and path-prefix expressions against a rule table.

Every rule is the expression host + path prefix up to its last ``/``. A url is expanded
into the same expressions (each host suffix of whole labels with each path prefix that
ends in ``/``), no deeper than the deepest rule. Rules are listed by the first 32 bits of their
expression's SHA-256, and urls meet these lists in an equi-join on that short prefix alone. Of a list
the rules that have the url's full digest and begin its path are then confirmed, and the longest rule
(host and path together, then the longer host, then block before allow, then alphabetic order)
decides. Partial aggregation reduces a url's matches to one row before any shuffle. The rule side is
left to Spark's own size-checked broadcast; a larger rule table is joined by a shuffle whose hot
prefixes AQE splits. A list holds the rules of one host and path up to the last ``/``.

Defined cases: null url or no ``://``: host and path are empty, no rule fits; a url without
a path fits no rule whose path is not empty; no fitting rule: ``default``; null or empty
rule tables: everything gets ``default``; rules with a null part are ignored (null path:
empty); repeated pages give repeated rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rule_short, its rules (digest, path, and what decides between rules), and the most labels and path parts of these."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    key_path = F.when(F.locate("/", path) > 0, F.expr("substring(coalesce(path, ''), 1, length(path) - locate('/', reverse(path)) + 1)")).otherwise(F.lit(""))
    digest = _digest(F.concat(host, F.lit("\n"), key_path))
    each = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(F.concat(host, path).alias("rule"), F.col("verdict").alias("rule_verdict"), path.alias("rule_path"), (F.length(host) + F.length(path)).alias("rule_length"), F.length(host).alias("rule_host_length"),
                F.size(F.split(host, r"\.")).alias("labels"), (F.length(key_path) - F.length(F.regexp_replace(key_path, "/", ""))).alias("depth"), digest.alias("rule_digest"), _short(digest).alias("rule_short"))
        .distinct()
    )
    own = F.struct("rule_digest", "rule_path", "rule_length", "rule_host_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")
    return each.groupBy("rule_short").agg(F.collect_list(own).alias("listed"), F.max("labels").alias("labels"), F.max("depth").alias("depth"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, fits (number of fitting rules) of every page; ``rules``: host, path, verdict."""
    ready = prepare_rules(rules)
    labels, depth = ready.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    urls = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    slashes = F.split("path", "/")
    most = F.least(F.size(slashes) - 1, F.lit(depth))
    paths = F.when(most < 1, F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(slashes, 1, k), "/"), F.lit("/")))))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(F.concat(h, F.lit("\n"), p)))))
    some = urls.withColumn("digest", F.explode_outer(F.when(F.lit(labels) > 0, keys))).withColumn("short", _short(F.col("digest")))
    met = some.join(ready, F.col("short") == F.col("rule_short"), "left")
    confirmed = F.filter("listed", lambda r: (r["rule_digest"] == F.col("digest")) & F.startswith(F.col("path"), r["rule_path"]))
    ranked = F.transform(confirmed, lambda r: F.struct(*(r[c].alias(c) for c in ("rule_length", "rule_host_length", "blocks", "rule", "rule_verdict"))))
    met = met.select("row", "page_id", "host", "path", ranked.alias("fitting"))
    out = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.array_max("fitting")).alias("best"), F.sum(F.when(F.col("fitting").isNotNull(), F.size("fitting")).otherwise(0)).alias("fits"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), "fits")
