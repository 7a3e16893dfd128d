"""Relational building blocks that the queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.sources.files import shared_path


def in_list(column: Column, values: list) -> Column:
    """Membership; an empty list matches nothing."""
    return column.isin(*values) if values else F.lit(False)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group; the order must end in a unique key. Spark keeps only k rows a group and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, by, order, 1, "__rn").drop("__rn")


def nearest_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """by and, for each name, the value whose place in order is floor((n - 1) share): over counts of distinct values, so that a group is as large as
    its values are many, not its rows."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by)
    placed = counted.withColumn("__upto", F.sum("__k").over(w.orderBy(value))).withColumn("__n", F.sum("__k").over(w))
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") > F.floor((F.col("__n") - 1) * F.lit(share)), F.col(value))).alias(name) for name, share in ranks.items()])


def row_numbers(df: DataFrame, by: list[str], order: list[str], rank: str = "rn") -> DataFrame:
    """row_number() over few or hot groups; `order` (names of columns, ascending) ends in a unique key.

    Rows are dealt by ranges of group and order, so a group takes as many tasks as it needs; each range numbers its own rows, and what a range
    lies behind is a sum over the counts of ranges, a small table. The ranges are written once, so that a lost task finds the same ones.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    path = shared_path(spark, "ranges")
    dealt.write.parquet(path)
    cut = spark.read.schema(dealt.schema).parquet(path)
    counts = cut.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    behind = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__range").alias("__of"), behind.alias("__base"))
    local = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__{k}")), by, F.col("__range") == F.col("__of"))
    met = local.join(F.broadcast(bases) if small(bases) else bases, same)
    return met.select(*df.columns, (F.col("__base") + F.col("__rn")).alias(rank))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of new replace those of old with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that does nothing on conflict."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule: one row for each rule that a row breaks (false, not null)."""
    broken = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def within(left: DataFrame, right: DataFrame, keys: list[str], start: str, at: str, hours: int) -> DataFrame:
    """Interval join: right rows whose time is in [start, start + hours) of a left row with equal keys.

    Both sides are dealt to time cells as wide as the interval, so that the join has an equality on time too and a busy key is spread
    over its cells; a left row looks into its own cell and the next.
    """
    width = hours * 3600
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    spread = left.withColumn("__cell", F.explode(F.array(cell(start), cell(start) + 1)))
    found = spread.join(right.withColumn("__cell", cell(at)), [*keys, "__cell"])
    return found.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.make_dt_interval(hours=F.lit(hours)))).drop("__cell")


def day_spine(df: DataFrame, by: list[str], day: str, first: str, last: str, counts: list[str]) -> DataFrame:
    """Every day of the range for every group, zeros where there is no row."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day)
    spine = df.select(*by).distinct().select(*by, days)
    return spine.join(df, [*by, day], "left").fillna(0, counts)


def streaks(active: DataFrame, by: list[str], day: str, today: Column) -> DataFrame:
    """by, streak: consecutive active days up to today, which may be empty yet, or yesterday."""
    w = Window.partitionBy(*by).orderBy(day)
    islands = active.select(*by, day).distinct().withColumn("__island", F.date_sub(day, F.row_number().over(w)))
    runs = islands.groupBy(*by, "__island").agg(F.max(day).alias("__last"), F.count("*").alias("__n"))
    alive = F.when(F.col("__last") >= F.date_sub(today, 1), F.col("__n")).otherwise(0)
    return runs.groupBy(*by).agg(F.max(alive).alias("streak"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def words(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of at least so many letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def overlaps(a: Column, b: Column) -> dict[str, Column]:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    part = lambda n: F.when(n > 0, both / n).otherwise(0.0)
    return {"jaccard": part(either), "containment": part(F.size(a)), "overlap": part(F.least(F.size(a), F.size(b)))}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def small(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether the planner's own bound of the size of a table allows a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
