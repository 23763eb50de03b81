"""Hilbert-curve sharding, DataFrame functions only.

Three metadata dimensions (language, source, size of the text) are quantised to 16 levels each; the Hilbert index of the
cell orders the rows, and the ordered rows are cut into runs. Rows of a run lie close together in all three dimensions,
so the min/max statistics of the shard files prune on any of them.

Strings take the level of their hash: equal values share a level, which is what equality filters need. Sizes take their
power of two.

Copies of a text are one group: they take the place of the group's smallest language and source and follow each other in the order, so that
only the cuts between shards (and the group's size, if it is larger than a shard) part them.

The order is global but no task sees it whole: the 4,096 cells are counted, a cell that holds more than its share is
split by a hash of the text, a text with more copies than a share forms parts of its own, and one running sum over the cells and their parts
(a table of fixed size) gives every part the place where it starts. Rows are then numbered inside their part.

Defined results: a null text has size 1 and CRC 0 and is a copy of the empty text; null lang or source takes level 0; copies are ordered by doc_id,
and rows equal in both, or copies of a text with more of them than a share, take their places in any order; an empty table gives an empty result; texts
of any length count with all their bytes.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, join_groups, materialize, text_key

BITS, DIMS = 4, 3
CELLS = 1 << (BITS * DIMS)
#: The rows are cut into cells and parts of at most about 1/PARTS of all rows.
PARTS = 2048


def level_of_string(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << BITS)).cast("int"))


def level_of_size(size: Column) -> Column:
    return F.least(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit((1 << BITS) - 1))


def hilbert_index(levels: list[Column]) -> Column:
    """Index on the Hilbert curve of a point with BITS bits in each dimension.

    The levels are changed into the transposed index by exchanging and inverting low bits from the top bit down, then
    Gray-decoded; the bits of the index are then read across the dimensions. Every step is one fold over an array.
    """
    n = len(levels)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(BITS - 1, 0, -1) for i in range(n)])

    def put(x: Column, at: Column, value: Column) -> Column:
        return F.transform(x, lambda v, k: F.when(k == at, value).otherwise(v))

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        first, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = put(x, F.lit(0), first.bitwiseXOR(low))
        exchanged = F.when(s["i"] == 0, x).otherwise(put(put(x, F.lit(0), first.bitwiseXOR(swap)), s["i"], own.bitwiseXOR(swap)))
        return F.when(own.bitwiseAND(s["q"]) != 0, inverted).otherwise(exchanged)

    turned = F.aggregate(steps, F.array(*[x.cast("int") for x in levels]), turn)
    grayed = F.aggregate(F.array(*[F.lit(i) for i in range(1, n)]), turned, lambda x, i: put(x, i, F.get(x, i).bitwiseXOR(F.get(x, i - 1))))
    last = lambda x: F.get(x, F.lit(n - 1))
    flip = lambda x: F.aggregate(F.array(*[F.lit(1 << b) for b in range(BITS - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(last(x).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    bits = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(BITS - 1, -1, -1) for i in range(n)])
    # a one-element transform binds the array to a variable, so that it is computed once
    read = F.transform(F.array(grayed), lambda x: F.aggregate(bits, F.lit(0), lambda h, s: h * 2 + F.call_function("getbit", F.get(x, s["i"]).bitwiseXOR(flip(x)), s["b"]).cast("int")))
    return F.get(read, F.lit(0))


def hilbert_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, text_key, lang_level, source_level, size_level, cell and place (0, 1, ... over all rows), and the number of rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key("text").alias("text_key"), level_of_string(F.col("lang")).alias("lang_level"), level_of_string(F.col("source")).alias("source_level"))
    rows = materialize(rows.withColumn("nth", F.monotonically_increasing_id()), "hilbert-rows")
    total = rows.count()
    share = max(1, -(-total // PARTS))
    groups = rows.groupBy("text_key").agg(F.min(F.struct("lang_level", "source_level")).alias("levels"), F.count(F.lit(1)).alias("copies"))
    whole = join_groups(rows.drop("lang_level", "source_level"), materialize(groups, "hilbert-groups"), "text_key", "copies", total).select("*", "levels.*").drop("levels")
    whole = whole.withColumn("size_level", level_of_size(F.col("size"))).withColumn("cell", hilbert_index([F.col("lang_level"), F.col("source_level"), F.col("size_level")]))
    whole = materialize(whole, "hilbert-cells")
    splits = whole.groupBy("cell").count().select("cell", F.ceil(F.col("count") / share).cast("int").alias("splits"))
    many = F.col("copies") > share
    own = F.when(many, F.col("text_key"))  # fewer than PARTS texts
    sub = F.when(many, F.pmod(F.xxhash64("doc_id", "nth"), F.ceil(F.col("copies") / share))).otherwise(F.lit(0))
    dealt = whole.join(F.broadcast(splits), "cell").withColumns({"part": F.pmod(F.xxhash64(F.lit(7), "text_key"), "splits").cast("int"), "own": own, "sub": sub})  # CELLS rows at most
    parts = ["cell", "part", "own", "sub"]
    starts = dealt.groupBy(*parts).count()  # CELLS + 3 * PARTS rows at most
    starts = starts.select(*[F.col(c).alias(f"at_{c}") for c in parts], (F.sum("count").over(Window.orderBy(*parts)) - F.col("count")).alias("start"))
    place = F.row_number().over(Window.partitionBy(*parts).orderBy("text_key", "doc_id", "nth")) - 1
    same = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in parts]
    placed = dealt.withColumn("inside", place).join(F.broadcast(starts), same).withColumn("place", F.col("start") + F.col("inside"))
    return placed.select("doc_id", "size", "text_crc32", "text_key", "lang_level", "source_level", "size_level", "cell", "place"), total


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Runs of the Hilbert order with row counts at most one apart: adds shard, slot (gapless from 0), law and grown_shard (null for this law)."""
    rows, total = hilbert_order(docs)
    total = max(total, 1)
    return (
        rows.withColumn("shard", F.expr(f"place * {shards}L div {total}L").cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L"))
        .withColumn("law", F.lit("rows"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write docs as one folder per shard, rows in Hilbert order. Rows equal in doc_id and text go to the first shard of theirs."""
    own_id, own_key, at, slot, key, folder = fresh_names(docs, "own_id", "own_key", "own_shard", "own_slot", "key_of_text", "shard_no")
    own = shard(docs, shards).groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.min(F.struct("shard", "slot")).alias(at))
    own = own.select(own_id, own_key, F.col(at)["slot"].alias(slot), F.col(at)["shard"].alias(at))
    found = docs.withColumn(key, text_key("text")).join(own, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)))
    out = found.repartitionByRange(at, slot).sortWithinPartitions(at, slot).withColumn(folder, F.col(at))
    out.drop(own_id, own_key, key, at, slot).write.partitionBy(folder).parquet(path)
