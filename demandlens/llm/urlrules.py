"""URL filters (9): sort-merge range join with a sorted sweep.

A host becomes its labels in reverse order, each followed by a dot
(``blog.a.net`` -> ``net.a.blog.``), so a rule for a host and all its
subdomains is the interval of keys that start with the rule's key:
``[net., net/)``, as ``/`` follows ``.``. URLs and interval starts are sorted
together by key; a sweep keeps a stack of the rules whose interval is still
open (they are nested), and judges each URL by the longest rule on the stack
whose path the URL's path starts with.

The key range is cut at quantiles of a bounded sample of the URL keys, which
include the page id, so one hot host or URL spreads over many parts. A rule is
copied into each part that its interval meets; each part is sorted and swept
by itself. The cuts balance the parts, they never change a result.

Null URLs and those without ``://`` have an empty host and path and meet no
rule. Repeated rows are judged alike. Null rules are dropped; of rules with
the same host and path, ``block`` wins. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import lowest_hash

#: The contract's rules (fixed values): action, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: URL keys sampled for the cuts at most.
CUT_SAMPLE = 20_000
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), *LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def key_of(host: Column) -> Column:
    """Labels in reverse order, a dot after each; an empty host has no key part."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _sweep(batches):
    """Judge rows sorted by (part, sort): the stack of open rules is the only
    state kept."""
    part, stack = None, []  # of (key, path, rule, action)
    names = ("page_id", "host", "path", "rule", "action")
    kinds = dict.fromkeys(names, pa.string()) | {"page_id": pa.int64()}
    for batch in batches:
        out = {k: [] for k in names}
        for row in batch.to_pylist():
            if row["part"] != part:
                part, stack = row["part"], []
            key, path = row["key"], row["path"]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row["action"] is not None:
                stack.append((key, path, row["host"] + path, row["action"]))
                continue
            best = (None, None)
            for _, start, rule, action in stack:  # from the shortest host to the longest
                if path.startswith(start) and (best[0] is None or len(rule) >= len(best[0])):
                    best = (rule, action)
            for k, v in zip(names, (row["page_id"], row["host"], path, *best), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in names], names=list(names))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page; where no rule fits
    the verdict is ``default``."""
    spark = pages.sparkSession
    urls = (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                         F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
            .withColumn("key", key_of(F.col("host")))
            .withColumn("sort", F.concat("key", F.lit("\u0001"), "path", F.lit("\u0001"),
                                         F.lpad(F.hex(F.coalesce("page_id", F.lit(0))), 16, "0"))))
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r["sort"] for r in lowest_hash(urls.select("sort"), CUT_SAMPLE, "sort").collect())
    cuts = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []

    def parted(batches):
        for batch in batches:
            parts = [bisect_right(cuts, x) for x in batch.column("sort").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], [*batch.schema.names, "part"])

    def spread(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            parts = [list(range(bisect_right(cuts, k), bisect_right(cuts, k[:-1] + "/") + 1)) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))],
                                             [*batch.schema.names, "parts"])

    starts = (rules.where("host is not null and host != '' and path is not null and action is not null")
              .groupBy(F.translate("host", *LOWER).alias("host"), "path").agg(F.max("action").alias("action"))
              .withColumn("key", key_of(F.col("host")))
              .mapInArrow(spread, "host string, path string, action string, key string, parts array<int>")
              .select(F.lit(None).cast("long").alias("page_id"), "host", "path", "key",
                      F.concat("key", F.lit("\u0000")).alias("sort"), F.explode("parts").alias("part"), "action"))
    urls = (urls.mapInArrow(parted, "page_id long, host string, path string, key string, sort string, part int")
            .withColumn("action", F.lit(None).cast("string")))
    return (urls.unionByName(starts).repartition("part").sortWithinPartitions("part", "key", F.col("action").isNull(), "path")
            .mapInArrow(_sweep, "page_id long, host string, path string, rule string, action string")
            .select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")))


#: The contract's result, for DuckDB.
ORACLE_SQL = """
WITH u AS (
  SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), p AS (
  SELECT page_id,
    CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), r(action, rhost, rpath) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), j AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, action
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
  coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM j GROUP BY page_id, host, path
"""
