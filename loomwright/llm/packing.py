"""Filling fixed-capacity containers by sum-of-squares online packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.automaton import DEFAULT_PATH
from loomwright.llm.tokens import count_tokens
from loomwright.session import cut

CAPACITY = 2048

#: Items that one packer takes, on average. More items waste less space; each packer is one task.
ITEMS_PER_PACKER = 100_000

_NEVER = np.iinfo(np.int64).max // 4


class SumOfSquares:
    """Online packer. ``level[h]`` counts the open containers filled to h; an item goes where the sum of the squared
    counts grows least (ties: the lowest level; a new container only if strictly better than every open one)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.containers = 0

    def _new(self) -> int:
        self.containers += 1
        return self.containers - 1

    def place(self, size: int) -> int:
        """The container of an item of 1..capacity."""
        cap, level = self.capacity, self.level
        if size >= cap:
            return self._new()
        # from level h to h + size the sum of squares grows by 2 (n[h+size] - n[h]) + 2, or 1 - 2 n[h] if that fills it
        now = level[1 : cap - size + 1]
        growth = 2 * (level[1 + size : cap + 1] - now) + 2
        growth[-1] = 1 - 2 * now[-1]
        growth[now == 0] = _NEVER
        best = int(growth.argmin())
        if growth[best] <= 2 * level[size] + 1:
            h = best + 1
            box = self.open[h].pop()
            level[h] -= 1
            if h + size < cap:
                level[h + size] += 1
                self.open.setdefault(h + size, []).append(box)
            return box
        box = self._new()
        level[size] += 1
        self.open.setdefault(size, []).append(box)
        return box

    def open_levels(self) -> dict[int, tuple[int, int]]:
        """Per open container its level, and its place among this packer's containers of that level."""
        return {box: (h, i) for h, boxes in self.open.items() for i, box in enumerate(boxes)}


def _pieces(sizes: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Items: each document whole, or if longer than the capacity, full pieces and a rest."""
    n = sizes["n"].to_numpy(dtype=np.int64)
    parts = -(-n // capacity)
    start = np.concatenate([np.arange(p, dtype=np.int64) * capacity for p in parts]) if len(n) else np.zeros(0, np.int64)
    out = sizes.loc[sizes.index.repeat(parts)].reset_index(drop=True)
    out["start"] = start
    out["length"] = np.minimum(out["n"].to_numpy(dtype=np.int64) - start, capacity)
    return out


def _pack(items: DataFrame, id_type: T.DataType, packers: int, first_packer: int, capacity: int) -> DataFrame:
    """One round: (container, id, start, length, packer, level, place); level is null where the container is full, else
    place is its place among the packer's containers of that level. Items spread evenly over the packers by a hash."""
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([*longs("container"), T.StructField("id", id_type), *longs("start", "length", "packer", "level", "place")])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id", "start"], kind="stable")
        packer = SumOfSquares(capacity)
        boxes = np.fromiter((packer.place(int(s)) for s in group["length"]), dtype=np.int64, count=len(group))
        still = packer.open_levels()
        base = (first_packer + int(group["packer"].iloc[0])) << 32
        out = pd.DataFrame({"container": base + boxes, "id": group["id"], "start": group["start"], "length": group["length"], "packer": group["packer"]})
        for name, at in (("level", 0), ("place", 1)):
            out[name] = pd.array([still[b][at] if b in still else None for b in boxes], dtype="Int64")
        return out

    return (
        items.withColumn("order", F.xxhash64("id", "start", F.monotonically_increasing_id()))
        .withColumn("packer", F.pmod("order", F.lit(packers)).cast("long"))
        .groupBy("packer")
        .applyInPandas(pack, schema)
    )


def merge_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """How to join open containers, ``counts[level]`` of each level: (level, first, number, group), the containers of a
    level that get the numbers group, group + 1, ...

    Fullest first, each with the fullest that still fit, many alike at once; every step uses up a level, so the plan has
    at most ``capacity`` steps of at most ``capacity`` levels, however many containers there are.
    """
    left, used, plan, group = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        room, kinds = capacity, {}
        for h in sorted(left, reverse=True):
            fit = min(room // h, left[h])
            if fit:
                kinds[h] = fit
                room -= fit * h
        times = min(left[h] // k for h, k in kinds.items())
        for h, k in kinds.items():
            for j in range(k):
                plan.append((h, used[h] + j * times, times, group))
            used[h] += k * times
            left[h] -= k * times
            if not left[h]:
                del left[h]
        group += times
    return plan


def _merged(packed: DataFrame, capacity: int, first_container: int) -> DataFrame:
    """Containers that packers left open, joined where they fit: (container, id, start, length)."""
    spark = packed.sparkSession
    sizes = packed.groupBy("packer", "level").agg((F.max("place") + 1).alias("n"))  # a row per packer and level
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("level").orderBy("packer")) - F.col("n")).drop("n")
    counts = {r.level: r.n for r in sizes.groupBy("level").agg(F.sum("n").alias("n")).collect()}  # at most capacity - 1 rows
    plan = spark.createDataFrame(merge_plan(counts, capacity) or [(0, 0, 0, 0)], "level long, first long, number long, group long")
    placed = packed.join(before, ["packer", "level"]).withColumn("at", F.col("before") + F.col("place"))
    steps = plan.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("first", "number", "group"))).alias("steps"))  # a row per level
    step = F.element_at(F.filter("steps", lambda x: x["first"] <= F.col("at")), -1)
    return (
        placed.join(F.broadcast(steps), "level")
        .withColumn("step", step)
        .select((F.lit(first_container) + F.col("step.group") + F.col("at") - F.col("step.first")).alias("container"), "id", "start", "length")
    )


def pack_sizes(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, items_per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """(container, id_col, start, length): place items into containers of ``capacity``.

    Items longer than the capacity are split into full pieces and a rest, all others stay whole. Null, zero and negative
    sizes are left out; a repeated row is an item of its own. An empty input gives an empty result. Container numbers are
    unique, not dense.

    Items are spread over packers of about ``items_per_packer``; the containers that a packer leaves open are emptied
    and packed again by fewer packers, until one is left. No packer takes more, whatever the input. Where a round leaves
    more than half of its items in open containers, emptying them again would gain little (their sizes do not fill
    containers up), and that round is the last. Hence there are at most log2(items) rounds. Containers that the last
    round leaves open are joined where they fit, level by level and across packers.
    """
    id_type = sizes.schema[id_col].dataType
    whole = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where(F.col("n") > 0)
    piece_type = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    items = cut(whole.mapInPandas(lambda it: (_pieces(b, capacity)[["id", "start", "length"]] for b in it), piece_type))
    first, done, n = 0, None, items.count()
    while True:
        packers = max(1, -(-n // items_per_packer))
        packed = cut(_pack(items, id_type, packers, first, capacity))
        first += packers
        rest = packed.where("level is not null")
        closed = packed.where("level is null").select("container", "id", "start", "length")
        done = closed if done is None else done.unionByName(closed)
        items, before = rest.select("id", "start", "length"), n
        n = items.count()
        if packers == 1 or 2 * n > before:
            return done.unionByName(_merged(rest, capacity, first << 32)).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = DEFAULT_PATH, items_per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """Pack texts by their token counts under the vocabulary at ``path``; see pack_sizes."""
    return pack_sizes(count_tokens(docs, id_col, text_col, path), id_col, "n_tokens", capacity, items_per_packer)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least number that could hold the tokens, pieces, tokens, and share of unused space."""
    per = packed.groupBy("container").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("filled") / capacity).alias("least"),
        F.sum("pieces").alias("pieces"),
        F.sum("filled").alias("tokens"),
        F.max("filled").alias("fullest"),
        (1 - F.sum("filled") / (F.count(F.lit(1)) * capacity)).alias("unused"),
    )
