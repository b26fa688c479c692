"""Tables kept in one folder per account, shared tables, schema evolution, and backup before truncation."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_ACCOUNT = "local"
SHARD = "shard"


def safe_account(account: str | None) -> str:
    """The folder name of an account: other characters than letters, digits, dot, dash and underscore become ``_``."""
    return re.sub(r"[^A-Za-z0-9_.-]", "_", account or "")[:120] or DEFAULT_ACCOUNT


def shard_of(account: Column) -> Column:
    """``safe_account`` of a column."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(account, "[^A-Za-z0-9_.-]", "_"), 1, 120), F.lit("")), F.lit(DEFAULT_ACCOUNT))


def write_shards(df: DataFrame, root: str, account: str = "account_id", mode: str = "append") -> None:
    """A folder for each account, by its safe name; the account itself stays in the rows.

    Rows of an account are brought together first, so a task writes few files; very large accounts are split by the
    writer's adaptive plan.
    """
    df.withColumn(SHARD, shard_of(F.col(account).cast("string"))).repartition(SHARD).write.mode(mode).partitionBy(SHARD).parquet(root)


def read_shard(spark: SparkSession, root: str, account: str | None, column: str = "account_id") -> DataFrame:
    """One account's rows: the partition filter prunes to its folder, and of accounts with one safe name it takes the own.

    Rows without an account belong to the default one.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(root).where(F.col(SHARD).cast("string") == safe_account(account))
    own = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(DEFAULT_ACCOUNT)) == (account or DEFAULT_ACCOUNT)
    return rows.where(own).drop(SHARD)


def read_all(spark: SparkSession, root: str, column: str = "account_id") -> DataFrame:
    """All shards, columns that some lack as null. Accounts stay texts even if they look like numbers."""
    df = spark.read.option("mergeSchema", "true").parquet(root).drop(SHARD)
    return df.withColumn(column, F.col(column).cast("string"))


def accounts(df: DataFrame, column: str = "account_id", default: str = DEFAULT_ACCOUNT) -> DataFrame:
    """The accounts that have rows, and the default one."""
    return df.select(column).unionByName(df.sparkSession.createDataFrame([(default,)], f"{column} string")).distinct()


def table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table, or no rows of its schema where the path does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The columns of a schema, in its order and types; what is absent gets its default, else null. Extra columns go."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def rekeyed(profiles: DataFrame, default_account: str = DEFAULT_ACCOUNT, default_scope: str = "global") -> DataFrame:
    """Rows moved under the key (account, scope), both filled in; of rows that then clash the latest stays."""
    from lodestone.operators.state import unique

    filled = profiles.withColumn("account_id", F.coalesce(F.nullif("account_id", F.lit("")), F.lit(default_account))).withColumn("scope", F.coalesce(F.nullif("scope", F.lit("")), F.lit(default_scope)))
    return unique(filled, ["account_id", "scope"], F.desc("updated_at"))


def backup_then_truncate(spark: SparkSession, tables: Mapping[str, str], backup_root: str, dry_run: bool = False) -> dict[str, int]:
    """Copies each table to the backup folder, then empties it; a dry run makes the backup too. Rows by table."""
    counts = {}
    for name, path in tables.items():
        df = spark.read.parquet(path)
        df.write.mode("overwrite").parquet(f"{backup_root}/{name}")
        kept = spark.read.parquet(f"{backup_root}/{name}")
        counts[name] = kept.count()
        if not dry_run:
            kept.limit(0).write.mode("overwrite").parquet(path)
    return counts


def largest_files(spark: SparkSession, folder: str, n: int, pattern: str = "*.jpg") -> DataFrame:
    """``path, length`` of the n largest files; contents are not read. Fewer files are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    out = files.orderBy(F.desc("length"), "path").limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} files in {folder}")
    return out


def capture_rows(batches: DataFrame, meta: str = "capture_meta") -> DataFrame:
    """One row for each entry of a batch's JSON list of captures."""
    schema = "array<struct<sequence_index:int,page_hint:string,question_hint:string,source:string,source_path:string>>"
    return batches.select("*", F.posexplode(F.from_json(meta, schema)).alias("part", "_c")).select(*[c for c in batches.columns if c != meta], "part", "_c.*")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
