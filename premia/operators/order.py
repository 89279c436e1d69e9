"""Row order, recency, splits, folds and sampling.

Rows have no position in Spark, so every operator takes the order or hash key it needs.
None of them sorts a group in one task: ranks come from range or hash buckets plus the
number of rows in the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from premia.functions.numbers import by_key
from premia.operators.quantiles import BINS, exact_quantiles
from premia.roles import N_FOLDS, ROLES, SEED
from premia.session import small_side, write_table

LATER_RECENCY = {"block2": 1.0, "block3": 1.2}
# Rows one task sorts at most, about.
BUCKET_ROWS = 250_000
DECILES = tuple(k * 0.1 for k in range(1, 10))


def row_index(
    df: DataFrame,
    order_by=ROLES.order_key,
    partition_by=(),
    name: str = "row_index",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based position of each row in key order, counted within ``partition_by``.

    The rows are range-partitioned on group and key, so a large group spreads over many
    tasks. Position and partition are written once, because a second evaluation of the
    range bounds could place rows differently. Project to what is needed first.
    """
    spark = df.sparkSession
    groups = list(partition_by)
    keys = groups + [k for k in order_by if k not in groups]
    # As many ranges as the counted rows need, however few partitions the session has.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = num_partitions or max(least, -(-df.select(*keys[:1]).count() // BUCKET_ROWS))
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    table = write_table(
        ranged.select("*", F.spark_partition_id().alias("_part"), in_part.alias("_pos")), "ordered"
    )
    spans = table.groupBy(*groups, "_part").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n")
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = spans.select(
        *groups,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    # One row per partition, plus one per group: broadcast, after a count if groups are open.
    side = small_side(starts) if groups else F.broadcast(starts)
    joined = table.join(side, [*groups, "_part"])
    return joined.select(*df.columns, (F.col("_pos") + F.col("_shift")).alias(name))


def with_group_count(df: DataFrame, partition_by, name: str) -> DataFrame:
    """Row count of each group of a bounded set of groups, as a literal lookup."""
    (group,) = partition_by
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    return df.withColumn(name, by_key(F.col(group), counts).cast("long"))


def quote_recency(train: DataFrame, order_by=ROLES.order_key) -> DataFrame:
    """Position over row count, in [0, 1)."""
    indexed = row_index(train, order_by, name="_idx")
    n = train.count()
    return indexed.withColumn("quote_recency", F.col("_idx") / F.lit(float(max(n, 1)))).drop("_idx")


def later_recency(df: DataFrame, block: str) -> DataFrame:
    return df.withColumn("quote_recency", F.lit(LATER_RECENCY[block]))


def recency_weight(quoted: DataFrame, order_by=ROLES.order_key) -> DataFrame:
    """Weight 0.5 for an insurer's oldest quoted row up to 1.0 for its newest."""
    indexed = row_index(quoted, order_by, ("insurer",), "_idx")
    counted = with_group_count(indexed, ("insurer",), "_n")
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    return counted.withColumn("weight", 0.5 + 0.5 * (F.col("_idx") / span)).drop("_idx", "_n")


def _whole(column: str, kind: T.DataType) -> Column | None:
    """The column as a 64-bit integer of the same order; None where it has no such form."""
    c = F.col(column)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        second = F.extract(F.lit("SECOND"), c) * 1_000_000
        minute = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
        return minute * 60_000_000 + second.cast("long")
    return None


def value_at(numbers: DataFrame, column: str, rank: int, bins: int = BINS) -> tuple[int | None, int]:
    """The value at a 0-based rank of an integer column, nulls first, and how many rows are below it.

    The interval that holds the rank is split into bins whose rows are counted, pre-aggregated before the
    shuffle, until one value is left: at most six passes for 64 bits. The driver gets the counts of the bins.
    """
    c = F.col(column)
    ends = numbers.agg(F.count(F.when(c.isNull(), 1)).alias("nulls"), F.min(c).alias("low"), F.max(c).alias("high")).first()
    below, low, high = ends["nulls"], ends["low"], ends["high"]
    if rank < below:
        return None, 0
    while low < high:
        width = (high - low) // bins + 1
        counted = numbers.where(c.between(low, high)).groupBy(F.expr(f"`{column}` div {width}").alias("bin"))
        found = counted.agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect()
        for r in sorted(found, key=lambda r: r["low"]):
            if rank < below + r["n"]:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low, below


def key_at(df: DataFrame, order_by, rank: int) -> dict[str, int | None] | None:
    """The key at a 0-based rank, each column as an integer; None where a column has no such form.

    Rows are neither sorted nor moved: the first column is searched by counting, the next among the rows
    that share its value, and so on.
    """
    numbers = {k: _whole(k, df.schema[k].dataType) for k in order_by}
    if any(v is None for v in numbers.values()):
        return None
    held, key = df.select(*[v.alias(k) for k, v in numbers.items()]), {}
    for column in order_by:
        key[column], below = value_at(held, column, rank)
        held, rank = held.where(F.col(column).eqNullSafe(F.lit(key[column]))), rank - below
    return key


def _before(columns, values) -> Column:
    """Lexicographic ``columns < values``, nulls first."""
    (column, *rest), (value, *others) = columns, values
    less = F.lit(False) if value is None else F.coalesce(column < F.lit(value), F.lit(True))
    if not rest:
        return less
    return less | (column.eqNullSafe(F.lit(value)) & _before(rest, others))


def temporal_split(
    df: DataFrame, order_by=ROLES.order_key, train_share: float = 0.8, name: str = "split"
) -> DataFrame:
    """Tag the first ``int(n * share)`` rows ``train`` and the rest ``valid``.

    The key at the cut is found by counting and every row is compared with it where it lies. Keys that hold
    other than whole numbers, dates and times are ranked instead, the key columns alone. Nulls come first;
    rows that share the key at the cut are all ``valid``.
    """
    n = df.count()
    cut = int(n * train_share)
    if cut >= n:
        return df.withColumn(name, F.lit("train"))
    boundary = key_at(df, order_by, cut)
    if boundary is None:
        ranked = row_index(df.select(*order_by), order_by, name="_idx")
        boundary = ranked.where(F.col("_idx") == cut).first().asDict()
        columns = [F.col(c) for c in order_by]
    else:
        columns = [_whole(c, df.schema[c].dataType) for c in order_by]
    before = _before(columns, [boundary[c] for c in order_by])
    return df.withColumn(name, F.when(before, "train").otherwise("valid"))


def decile_edges(quoted: DataFrame, target: str = "y") -> dict[str, tuple[float, ...]]:
    """Distinct inner decile edges above the minimum, per insurer."""
    found = exact_quantiles(quoted, target, DECILES, by=["insurer"])
    return {
        k[0]: tuple(sorted({e for e in q.values if e > q.minimum})) for k, q in found.items()
    }


def decile_bins(quoted: DataFrame, target: str = "y", edges=None) -> DataFrame:
    """Right-closed decile bin per insurer; equal edges are dropped, ties stay together."""
    edges = decile_edges(quoted, target) if edges is None else edges
    if not edges:
        return quoted.withColumn("bin", F.lit(None).cast("int"))
    pairs = []
    for insurer, cuts in edges.items():
        pairs += [F.lit(insurer), F.lit(list(cuts)).cast("array<double>")]
    cuts = F.element_at(F.create_map(*pairs), F.col("insurer"))
    return quoted.withColumn("bin", F.size(F.filter(cuts, lambda e: e < F.col(target))))


def salted_hash(key: str, *salt) -> Column:
    """Hex digest of salt and key; the same on every run, machine and partitioning."""
    prefix = "|".join(str(s) for s in salt)
    return F.md5(F.concat(F.lit(prefix + "|"), F.col(key).cast("string")))


def bucket_digits(df: DataFrame, groups, rows: int = BUCKET_ROWS) -> int:
    """Leading digest digits that cut the largest group into buckets of about ``rows``."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    digits = 0
    while largest > rows * 16**digits:
        digits += 1
    return digits


def hash_rank(
    df: DataFrame, group_by, key: str, salt, name: str = "rank", digits: int | None = None
) -> DataFrame:
    """0-based rank of each row in digest order within its group.

    A group is cut into ``16 ** digits`` equal buckets by the leading digits, so no task
    sorts a whole large group. Ranking and bucket sizes are keyed alike.
    """
    groups = list(group_by)
    digits = bucket_digits(df, groups) if digits is None else digits
    bucketed = df.withColumn("_h", salted_hash(key, *salt)).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    sizes = bucketed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *groups, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(*groups, "_b").orderBy("_h", key)
    ranked = bucketed.withColumn("_rn", F.row_number().over(within) - 1)
    joined = ranked.join(starts, [*groups, "_b"])
    return joined.select(*df.columns, (F.col("_start") + F.col("_rn")).alias(name))


def stratified_folds(
    binned: DataFrame, key: str = ROLES.key, n_folds: int = N_FOLDS, seed: int = SEED
) -> DataFrame:
    """Shuffled folds that hold equal shares of every insurer's decile bins."""
    ranked = hash_rank(binned, ("insurer", "bin"), key, (seed,), "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % n_folds).cast("int")).drop("_rank")


def bag_sample(
    df: DataFrame,
    key: str = ROLES.key,
    share: float = 0.85,
    seed: int = SEED,
    bag: int = 0,
    fold: int = 0,
    group_by=("insurer",),
    digits: int | None = None,
) -> DataFrame:
    """Exactly ``floor(share * n)`` rows of every group, without replacement.

    The sample is the rows up to the digest of that rank. Only the one bucket per group
    that holds this rank is ordered; the rows themselves are filtered in place.
    """
    (group,) = group_by
    digest = salted_hash(key, seed, bag, fold)
    last = bag_ends(df, key, share, seed, bag, fold, group_by, digits)
    chosen = (F.col("_h") < F.col("_cut")) | (
        (F.col("_h") == F.col("_cut")) & (F.col(key) <= F.col("_cut_key"))
    )
    return (
        df.withColumn("_h", digest).join(F.broadcast(last), group).where(chosen).select(*df.columns)
    )


def bag_ends(
    df: DataFrame, key: str, share: float, seed: int, bag: int, fold: int, group_by=("insurer",), digits: int | None = None
) -> DataFrame:
    """Per group the digest (``_cut``) and key (``_cut_key``) of the last row of a sample."""
    groups = list(group_by)
    (group,) = groups
    digits = bucket_digits(df, groups) if digits is None else digits
    digest = salted_hash(key, seed, bag, fold)
    hashed = df.select(group, digest.alias("_h"), F.col(key).alias("_k")).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    sizes = hashed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    cut = (
        sizes.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_take", F.floor(F.sum("_n").over(whole) * share))
        .where((F.col("_take") <= F.col("_upto")) & (F.col("_take") > F.col("_upto") - F.col("_n")))
        .select(group, "_b", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    inside = Window.partitionBy(group).orderBy("_h", "_k")
    return (
        # One row per group.
        hashed.join(F.broadcast(cut), [group, "_b"])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_left"))
        .select(F.col(group), F.col("_h").alias("_cut"), F.col("_k").alias("_cut_key"))
    )


def fold_split(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the other folds, rows of this fold."""
    return folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)

