"""Helpers shared by the corpus operators: scratch tables, word rules, joins that survive hot keys."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with at least one row in this many is "hot"; there can be no more hot groups than this.
HOT_SHARE = 1000
#: Groups of fewer rows, and tables that one task can join whole, are never spread by join_salted.
SMALL_GROUP, SMALL_TABLE = 256, 10_000
#: Narrow rows that one task writes.
ROWS_A_FILE = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words of the decontamination and licence operators: runs of ASCII letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerspark-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is set, a temporary folder in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or _own_root()).rstrip("/")


def materialize(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts lineage and survives lost executors.

    Where the number of its rows is bounded by `most`, narrow rows are written by no more tasks than that needs.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    (df if most is None else df.coalesce(max(1, -(-most // ROWS_A_FILE)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is the same and far cheaper where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text, [] for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def text_key(text: Column | str) -> Column:
    """64-bit hash of a text, null as empty: tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row per group (every key of rows is in groups), safe where one group holds a large share of the rows.

    Groups of at least total / HOT_SHARE rows, of which there are HOT_SHARE at most, are broadcast; the others are
    shuffled, and none of those can fill a task. key must not be null in either input; size is the row count of a group.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE >= total)
    cold = groups.filter(F.col(size) * HOT_SHARE < total)
    first = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return first.unionByName(rest)


def join_salted(rows: DataFrame, groups: DataFrame, key: str, by: str, total: int, how: str = "inner", counted: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Join of rows (about total of them) to groups (at most one row per key), in which the rows of a hot key are spread over several tasks by the column `by`.

    Only the hot keys are broadcast, HOT_SHARE at most; the group's own row, however large, is copied once for each task of its key. counted
    holds the keys of rows where counting rows themselves would compute them twice. key must not be null in rows.
    """
    counted = rows if counted is None else counted
    if total <= SMALL_TABLE:
        return rows.join(groups.hint(hint) if hint else groups, key, how)
    most = max(total // HOT_SHARE, SMALL_GROUP)
    hot = counted.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).alias("salts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1)))).drop("salts")
    copies = groups.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(copies.hint(hint) if hint else copies, [key, "salt"], how).drop("salt")


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, by: str, total: int, hint: str | None = None) -> DataFrame:
    """Inner join of rows (total of them) to groups (one row per key), which tell by the column `size` how many rows each key has: the rows of a hot key are spread over several tasks by `by`.

    As join_salted, but without counting rows that are dear to compute. Only the hot keys are broadcast, HOT_SHARE at most; size is dropped. keys must not be null.
    """
    if total <= SMALL_TABLE:
        plain = groups.drop(size)
        return rows.join(plain.hint(hint) if hint else plain, keys)
    most = max(total // HOT_SHARE, SMALL_GROUP)
    salts = F.ceil(F.col(size) / most)
    hot = groups.filter(F.col(size) > most).select(*keys, salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1)))).drop("salts")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1))).drop(size)
    return salted.join(copies.hint(hint) if hint else copies, [*keys, "salt"]).drop("salt")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has (in any case) as columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
