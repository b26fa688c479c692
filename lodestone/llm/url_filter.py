"""URL filters as a sort-merge range join over reversed-host keys.

A rule ``host/path`` becomes the interval of all canonical keys that start with its own key. A url has one key for
each suffix of its host, so that "the host and its subdomains, and the path starts with" is a prefix test. Keys and
interval starts are sorted together; one pass keeps the stack of the rules that are open at the current key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, written

#: Ends an interval: no UTF-8 text has this byte, so every key with the rule's prefix sorts below prefix + END.
END = b"\xff"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www``, each label closed by a byte that sorts below all that hosts hold."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by key, rules before urls of the same key: the innermost open rule of each url's key.

    Only the stack outlives a batch. Prefix intervals are nested or disjoint, so a rule is closed for good once a key
    does not start with its prefix. A rule repeated at the start of a later slice is already open.
    """
    stack: list[tuple[bytes, int]] = []
    for batch in batches:
        keys, rules = [], []
        for key, rule in zip(batch["key"], batch["rule_no"], strict=True):
            key = bytes(key)
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule < 0 and stack:
                keys.append(key)
                rules.append(stack[-1][1])
            elif rule >= 0 and (not stack or stack[-1][1] != rule):
                stack.append((key, rule))
        yield pd.DataFrame({"key": pd.Series(keys, dtype="object"), "rule_no": pd.Series(rules, dtype="int64")})


def ranks(cuts: list[bytes], keys: pd.Series, side: str, end: bytes = b"") -> np.ndarray:
    """Where each key, followed by ``end``, lies among the sorted cuts."""
    sought = np.empty(len(keys), object)
    sought[:] = [bytes(k) + end for k in keys]
    among = np.empty(len(cuts), object)
    among[:] = cuts
    return np.searchsorted(among, sought, side=side).astype("int32")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Judges every url by its longest fitting rule: the id, ``host, path, rule, verdict``.

    ``rules``: ``host string, path string, verdict string``. A rule fits its host and all subdomains if the url's path
    starts with the rule's. The longest ``host || path`` wins; of equally long ones the first by text. The same rule
    given twice counts once, the smaller verdict by text ("allow" before "block"). No rule: ``rule`` is null and
    ``verdict`` is ``default``, the filter's own. A null url, or one without ``://``, has an empty host and path, which no
    rule fits. Rows with equal or null ids are all kept, one out for each in. Other columns are ignored.

    Urls are first reduced to distinct (host, path), and their keys to distinct keys, by aggregates that combine before the
    shuffle: all hosts under one suffix share its key, which is swept once. Keys and rules are cut at the same quantiles of
    the distinct keys. A rule goes to every slice that its interval meets (few rules span several), and within a slice rules
    and keys are sorted once and swept. What a key meets is joined back to its urls.
    """
    spark = pages.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    given = (
        rules.select(ascii_lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and host <> ''")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("rule_no", F.xxhash64("host", "path").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
        .withColumn("key", F.encode(F.concat(reversed_host(F.col("host")), F.lit("\u0002"), F.col("path")), "utf-8"))
    )
    # Two hashes name a (host, path), so that no url gets the verdict of another.
    name = [F.xxhash64("host", "path").alias("row"), F.hash("path", "host").alias("check")]
    shapes = parsed.where("host <> ''").groupBy("host", "path").count().select("host", "path", *name)
    labels = F.split("host", r"\.")
    keys = written(shapes.select(
        "row", "check", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(F.reverse(labels), F.lit(1), n), "\u0001"), F.lit("\u0001")))).alias("suffix"),
    ).select("row", "check", F.encode(F.concat("suffix", F.lit("\u0002"), "path"), "utf-8").alias("key")), "url-keys")
    each = keys.select("key").distinct()
    # Bounded: fifty keys for each slice come to the driver, chosen by their hashes.
    some = sorted(bytes(r["key"]) for r in each.orderBy(F.xxhash64("key"), "key").limit(50 * count).collect())
    cuts = sorted({some[i * len(some) // count] for i in range(1, count)} if some else set())

    slice_of = F.pandas_udf(lambda key: pd.Series(ranks(cuts, key, "right")), "int")
    slices_of = F.pandas_udf(lambda key: pd.Series([list(range(a, b + 1)) for a, b in zip(ranks(cuts, key, "right"), ranks(cuts, key, "left", END), strict=True)]), "array<int>")
    both = each.select("key", F.lit(-1).cast("long").alias("rule_no"), slice_of("key").alias("slice")).unionByName(given.select("key", "rule_no", F.explode(slices_of("key")).alias("slice")))
    swept = both.repartition(count, "slice").sortWithinPartitions("slice", "key", F.desc("rule_no")).select("key", "rule_no").mapInPandas(sweep, "key binary, rule_no long")
    found = keys.join(written(swept, "swept"), "key").select("row", "check", "rule_no")
    longest = found.join(given.select("rule_no", "rule", "verdict"), "rule_no").groupBy("row", "check").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("won"))
    # Urls without a host, of which there may be very many, need no partner.
    bare = parsed.where("host = ''").select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return (
        parsed.where("host <> ''").select(id_col, "host", "path", *name).join(longest, ["row", "check"], "left")
        .select(id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
        .unionByName(bare)
    )
