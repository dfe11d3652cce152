"""A stated query set against all rows, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import parallelism

#: Queries of one block; each row meets one block at a time, as an array inside its own task.
BLOCK = 512
#: Blocks that are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 4


def against_all(queries: DataFrame, rows: DataFrame, score: Column, query_keys: list[str], row_keys: list[str], block: int = BLOCK, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(query keys, row keys, score) of every query with every row.

    Queries are numbered into blocks of at most ``block``; a block is one row with an array. Up to ``BROADCAST_BLOCKS`` blocks
    are broadcast. Beyond, the rows are spread by a salt, a block is repeated once per salt, and both meet by (block, salt):
    no task holds more than one block and its share of the rows. Rows are repeated once per block either way, and take its
    array apart in the same task.
    """
    from loomwright.operators.ranking import numbered

    n = queries.count()
    blocks = max(1, -(-n // block))
    packed = numbered(queries, query_keys, "_n").groupBy((F.col("_n") / block).cast("int").alias("_block")).agg(F.collect_list(F.struct(*queries.columns)).alias("_queries"))
    repeated = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks <= broadcast_blocks:
        joined = repeated.join(F.broadcast(packed), "_block")  # at most broadcast_blocks x block queries
    else:
        salts = parallelism(rows.sparkSession)
        salted = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = repeated.withColumn("_salt", F.pmod(F.xxhash64(*row_keys), F.lit(salts)).cast("int")).join(salted.hint("shuffle_hash"), ["_block", "_salt"]).drop("_salt")
    return joined.select(*row_keys, *[c for c in rows.columns if c not in row_keys], F.explode("_queries").alias("_q")).select("*", "_q.*").select(*query_keys, *row_keys, score)
