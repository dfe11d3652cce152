"""Top-k, first per key, paging, numbering, sampling and capped queues, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.filters import within
from loomwright.session import cut


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; planned as a heap per partition, never a full sort."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key with their rank; each partition drops all but k rows per key before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1, "_rank").drop("_rank")


def page(df: DataFrame, order: list[Column], number: int | None, size: int | None) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, held within 1..200."""
    size = within(size, 1, 200, 20)
    return df.orderBy(*order).offset((max(number or 1, 1) - 1) * size).limit(size)


def numbered(df: DataFrame, order: list[str], name: str = "ord", start: int = 0) -> DataFrame:
    """Dense numbers in the given total order.

    Range-partitioned, then every partition sorts and counts on from the rows before it; the counts of the partitions, one
    row each, are all that passes through one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # both uses must see the same ranges
    local = Window.partitionBy("_part").orderBy(*order)
    ranked = ranged.withColumn("_local", F.row_number().over(local))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local") - 1 + start).drop("_part", "_local", "_before")  # a row per partition


def systematic_sample(df: DataFrame, order: list[str], rate: float) -> DataFrame:
    """ceil(n * rate) rows, every stride-th in the given order, from the first on."""
    n = df.count()
    want = -int(-n * rate // 1)
    stride = max(1, n // want) if want else 1
    return numbered(df, order).where((F.col("ord") % stride == 0) & (F.col("ord") / stride < want))


def thinned(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row in the given order."""
    step = max(1, -(-df.count() // most))
    return numbered(df, order).where(F.col("ord") % step == 0)


def capped_queue(df: DataFrame, classes: list[Column], order: list[str], cap: int) -> DataFrame:
    """Rows by the first class that they meet, in order within a class, with their place; ``picked`` up to ``cap``."""
    priority = F.coalesce(*[F.when(c, i) for i, c in enumerate(classes)], F.lit(len(classes)))
    queue = numbered(df.withColumn("priority", priority), ["priority", *order], "place", 1)
    return queue.withColumn("picked", (F.col("place") <= cap) & (F.col("priority") < len(classes)))


def review_plan(df: DataFrame, classes: list[Column], order: list[str], rate: float, cap: int) -> DataFrame:
    """Rows with their class (the first of ``classes`` that they meet, else len(classes)), and for those to review their
    place and reason (their class; len(classes) for a probe).

    Classes come one after the other, each in the given order; then probes, a systematic sample at ``rate`` of the rows in
    no class. The queue ends at ``cap`` (none for 0 or less); whatever is past it has no place.
    """
    n = len(classes)
    first = F.coalesce(*[F.when(c, i) for i, c in enumerate(classes)], F.lit(n))
    rows = cut(numbered(df, order, "ord", 1).withColumn("class", first))
    clear = rows.where(F.col("class") == n)
    size = clear.count()
    want = -int(-size * rate // 1) if rate > 0 else 0
    stride = max(1, size // want) if want else 1
    probe = (F.col("_i") % stride == 0) & (F.col("_i") / stride < want)
    marked = numbered(clear, ["ord"], "_i").withColumn("_probe", probe).drop("_i")
    every = cut(rows.where(F.col("class") < n).withColumn("_probe", F.lit(False)).unionByName(marked))
    chosen = (F.col("class") < n) | F.col("_probe")
    queue = numbered(every.where(chosen), ["class", "ord"], "place", 1)
    queue = queue.withColumn("place", F.when((F.col("place") <= cap) | F.lit(cap <= 0), F.col("place").cast("long")))
    reason = F.when(F.col("place").isNotNull(), F.col("class"))
    return queue.unionByName(every.where(~chosen).withColumn("place", F.lit(None).cast("long"))).drop("_probe").withColumn("reason", reason)


def escalated(plan: DataFrame, defect: Column, order: list[str], rate: float, budget: int) -> DataFrame:
    """If at least ``rate`` of the judged probes of a review plan prove defective, and one at all, the first ``budget`` of the
    rows that have no place and are in no class; else none."""
    last = plan.agg(F.max("class").alias("n")).first().n
    probes = plan.where((F.col("class") == F.lit(last)) & F.col("place").isNotNull())
    judged = probes.agg(F.count(F.lit(1)).alias("judged"), F.coalesce(F.sum(defect.cast("long")), F.lit(0)).alias("bad")).first()
    go = judged.bad > 0 and judged.bad / judged.judged >= rate
    return top_n(plan.where((F.col("class") == F.lit(last)) & F.col("place").isNull()), [F.asc(c) for c in order], budget if go else 0)
