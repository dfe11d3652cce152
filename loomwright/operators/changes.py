"""Incremental comparison, change capture, merge, and hash-chain verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(c: Column) -> Column:
    """SHA-256 in hexadecimal; the empty string for null and empty content."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "").otherwise(F.sha2(c, 256))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by a full outer join and null-safe comparison."""
    o = old.select(F.col(key).alias(key), F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(F.col(key).alias(key), F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return o.join(n, key, "full").select(key, change.alias("change"))


def merged(old: DataFrame, new: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Old rows that stayed the same, and new rows of changed and added keys."""
    keys = lambda *kinds: plan.where(F.col("change").isin(*kinds)).select(key)
    return old.join(keys("same"), key, "left_semi").unionByName(new.join(keys("changed", "added"), key, "left_semi"), allowMissingColumns=True)


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of each field that differs between two versions with the same key."""
    pack = lambda df, name: df.select(key, F.array(*[F.col(f).cast("string") for f in fields]).alias(name))
    pairs = pack(old, "_o").join(pack(new, "_n"), key)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.col("_o").alias("old_value"), F.col("_n").alias("new_value"))).alias("c")
    return pairs.select(key, each).select(key, F.col("c.field"), F.col("c.old_value"), F.col("c.new_value")).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def chain_text(previous: Column, fields: list[str]) -> Column:
    """What is hashed: the previous hash and the fields, separated by pipes, null as empty."""
    return F.concat_ws("|", previous, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def append_chain(log: DataFrame, group: str, order: list[str], fields: list[str], hash_col: str, genesis: str = "GENESIS") -> DataFrame:
    """The log with the hash of each entry, which covers the hash before it: the chain of each group, in order.

    Hashes of one chain follow from each other, so a chain is written by one task; it streams through it, batch by batch,
    and nothing but the last hash is kept. Chains spread over tasks.
    """
    columns = log.columns
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    schema = T.StructType([*log.schema.fields, T.StructField(hash_col, T.StringType())])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, genesis
        for b in batches:
            hashes = []
            for g, part in zip(b["_group"], b["_text"]):
                if g != at:
                    at, last = g, genesis
                last = hashlib.sha256(f"{last}|{part}".encode()).hexdigest()
                hashes.append(last)
            out = b[columns].copy()
            out[hash_col] = pd.Series(hashes, index=out.index, dtype=object)
            yield out

    keyed = log.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit(""))).withColumn("_text", text)
    return keyed.repartition("_group").sortWithinPartitions("_group", *order).mapInPandas(chain, schema)


def verify_chain(log: DataFrame, group: str, order: list[str], fields: list[str], hash_col: str, genesis: str = "GENESIS") -> DataFrame:
    """(group, total, first_broken): how many entries a chain has and the index, from 0, of the first whose hash does not
    follow from the stored previous one, null for a sound chain. An entry without a hash is broken.

    Up to the first break the last verified hash is the previous row's, so a lag is exact; each chain is sorted apart.
    """
    w = Window.partitionBy(group).orderBy(*order)
    expected = F.sha2(chain_text(F.coalesce(F.lag(hash_col).over(w), F.lit(genesis)), fields), 256)
    checked = log.withColumn("_i", F.row_number().over(w) - 1).withColumn("_ok", F.coalesce(F.col(hash_col) == expected, F.lit(False)))
    return checked.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.min(F.when(~F.col("_ok"), F.col("_i"))).cast("long").alias("first_broken"))


def missing_chunks(parts: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """(key, missing): indices 0..total-1 that a chunked upload still lacks."""
    wanted = parts.groupBy(key).agg(F.max(total).alias("_n")).where("_n > 0").select(key, F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("missing"))
    return wanted.join(parts.select(key, F.col(index).cast("int").alias("missing")), [key, "missing"], "left_anti")


# States of a defect, and which may follow each.
DEFECT_MOVES = {
    "pending": ["processing", "ignored", "falsePositive"],
    "processing": ["resolved", "ignored", "pending", "falsePositive"],
    "resolved": ["processing"],
    "ignored": ["processing"],
    "falsePositive": ["processing", "pending"],
}


def may_follow(before: Column, after: Column, moves: dict[str, list[str]] = DEFECT_MOVES) -> Column:
    """Whether a status may follow another; never if one of them is null or unknown."""
    return F.coalesce(F.concat(before, F.lit(">"), after).isin([f"{a}>{b}" for a, bs in moves.items() for b in bs]), F.lit(False))


def status_merge(local: DataFrame, remote: DataFrame, key: str, moves: dict[str, list[str]] = DEFECT_MOVES) -> DataFrame:
    """(key, action): changed where the remote status differs and the move is allowed, skipped where it is not, unchanged."""
    both = local.select(key, F.col("status").alias("_from")).join(remote.select(key, F.col("status").alias("_to")), key)
    allowed = may_follow(F.col("_from"), F.col("_to"), moves)
    return both.select(key, F.when(F.col("_from").eqNullSafe(F.col("_to")), "unchanged").when(allowed, "changed").otherwise("skipped").alias("action"))


def dataset_checks(df: DataFrame, key: str, enums: dict[str, list[str]]) -> DataFrame:
    """(check, bad): rows with a repeated key, and rows with a value outside each column's list."""
    n = F.count(F.lit(1))
    repeated = df.groupBy(key).agg(n.alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("bad")).select(F.lit(f"unique:{key}").alias("check"), "bad")
    counts = df.agg(*[F.coalesce(F.sum(F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), 1)), F.lit(0)).alias(c) for c, v in enums.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"enum:{c}").alias("check"), F.col(c).cast("long").alias("bad")) for c in enums])).alias("x")
    return repeated.unionByName(counts.select(pairs).select("x.*"))
