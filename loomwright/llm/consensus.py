"""Consensus of disagreeing annotators by message passing on the bipartite graph of label edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.skew import spread_join
from loomwright.session import cut

#: Up to this many (class, annotator) rows of summed messages are broadcast to the edges; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Partitions that an item's edges spread over.
SALTS = 4

#: Pseudo-counts of right and wrong labels that every annotator starts with.
RIGHT, WRONG = 2.0, 1.0


def plain(c: Column) -> Column:
    """One spelling for full-width, upper-case and padded variants."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
    narrow = "".join(chr(0x21 + i) for i in range(94)) + "  "
    return F.lower(F.trim(F.regexp_replace(F.translate(c, wide, narrow), r"\s+", " ")))


def latest_labels(votes: DataFrame) -> DataFrame:
    """One label per (item, annotator) of votes(item, annotator, label, at): the one with the latest ``at``.

    Rows with a null item, annotator or label do not count. A null ``at`` is the earliest; at the same time the larger
    label wins, so repeated rows change nothing.
    """
    return (
        votes.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isNotNull())
        .groupBy("item", "annotator")
        .agg(F.max(F.struct("at", "label")).alias("v"))
        .select("item", "annotator", F.col("v.label").alias("label"))
    )


@dataclass
class Consensus:
    """items(item, label, belief, votes, votes_for): belief that ``label`` is right. annotators(class, annotator, votes,
    sensitivity, specificity, reliability): reliability is their sum less one, 1 for always right, 0 for chance, below 0
    for misleading. rounds: how many rounds ran."""

    items: DataFrame
    annotators: DataFrame
    rounds: int


def consensus(labels: DataFrame, classes: list[str], rest: str | None = None, tolerance: float = 1e-3, max_rounds: int = 1000) -> Consensus:
    """Message passing on labels(item, annotator, label), each pair at most once, one class against the rest.

    Per class and edge, an item tells an annotator how probable it is that the item belongs to the class, from the
    messages of its other annotators only; an annotator tells an item the log-likelihood ratio of its label, from how it
    labelled its other items, as told by them: how often it says the class where it holds (sensitivity), and does not
    where it does not (specificity). Rounds go on until no message changes by more than ``tolerance``, an error after
    ``max_rounds``. Annotators who mislead get a negative weight, those who guess none. Leaving out the own edge keeps an annotator from confirming
    itself.

    With ``rest``, ``classes`` must be one class, and items that it does not win are labelled ``rest``; else the class
    with the highest belief wins, ties going to the first in ``classes``. Items without a vote do not appear. Work per
    round: one pass over the edges; sums per annotator and per item are aggregated before they move, and meet the edges by
    salted joins, so that no task holds all edges of an item or annotator.
    """
    one = F.explode(F.array(*map(F.lit, classes)))
    edges = labels.withColumn("class", one).select("class", "item", "annotator", (F.col("label") == F.col("class")).cast("double").alias("says"))
    sign = 2 * F.col("says") - 1
    start = F.col("total") - sign  # majority of the others
    state = cut(_with_totals(edges, sign).withColumn("told", 1 / (1 + F.exp(-start))).withColumn("belief", 1 / (1 + F.exp(-F.col("total")))).drop("total"))
    small = edges.select("class", "annotator").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rounds = 0
    while True:
        rounds += 1
        state = cut(_round(state, small))
        moved = state.agg(F.max(F.abs(F.col("told") - F.col("before")))).first()[0]
        if moved is None or moved <= tolerance:
            break
        if rounds >= max_rounds:
            raise RuntimeError(f"messages still change by {moved} after {max_rounds} rounds")
    per_item = state.groupBy("item", "class").agg(F.first("belief").alias("belief"), F.count(F.lit(1)).alias("votes"), F.sum("says").cast("long").alias("votes_for"))
    if rest is not None:
        wins = F.col("belief") > 0.5
        items = per_item.select(
            "item",
            F.when(wins, F.col("class")).otherwise(F.lit(rest)).alias("label"),
            F.when(wins, F.col("belief")).otherwise(1 - F.col("belief")).alias("belief"),
            "votes",
            F.when(wins, F.col("votes_for")).otherwise(F.col("votes") - F.col("votes_for")).alias("votes_for"),
        )
    else:
        place = F.array_position(F.array(*map(F.lit, classes)), F.col("class"))
        best = F.max(F.struct("belief", (-place).alias("place"), "class", "votes", "votes_for")).alias("b")
        items = per_item.groupBy("item").agg(best).select("item", F.col("b.class").alias("label"), "b.belief", "b.votes", "b.votes_for")
    says, belief = F.col("says"), F.col("belief")
    annotators = (
        state.groupBy("class", "annotator")
        .agg(F.count(F.lit(1)).alias("votes"), F.sum(belief * says).alias("tp"), F.sum(belief).alias("p"), F.sum((1 - belief) * (1 - says)).alias("tn"), F.sum(1 - belief).alias("n"))
        .withColumn("sensitivity", (F.col("tp") + RIGHT) / (F.col("p") + RIGHT + WRONG))
        .withColumn("specificity", (F.col("tn") + RIGHT) / (F.col("n") + RIGHT + WRONG))
        .withColumn("reliability", F.col("sensitivity") + F.col("specificity") - 1)
        .select("class", "annotator", "votes", "sensitivity", "specificity", "reliability")
    )
    return Consensus(items, annotators, rounds)


def _with_totals(edges: DataFrame, weight: Column) -> DataFrame:
    """Edges with the sum of the weights of all edges of their class and item."""
    sums = edges.groupBy("class", "item").agg(F.sum(weight).alias("total"))
    return spread_join(edges, sums, ["class", "item"], F.xxhash64("annotator"), SALTS)


def _round(state: DataFrame, small: bool) -> DataFrame:
    says, told = F.col("says"), F.col("told")
    own = {"tp": told * says, "fn": told * (1 - says), "fp": (1 - told) * says, "tn": (1 - told) * (1 - says)}
    sums = state.groupBy("class", "annotator").agg(*[F.sum(c).alias(k) for k, c in own.items()])
    prior = state.groupBy("class").agg((F.sum("belief") / F.count(F.lit(1))).alias("share"))
    key = ["class", "annotator"]
    with_sums = state.join(F.broadcast(sums), key) if small else spread_join(state, sums, key, F.xxhash64("item"))
    joined = with_sums.join(F.broadcast(prior), "class")  # prior: a row per class
    tp, fn, fp, tn = (F.col(k) - c for k, c in own.items())
    sens, spec = (tp + RIGHT) / (tp + fn + RIGHT + WRONG), (tn + RIGHT) / (tn + fp + RIGHT + WRONG)
    weight = F.when(says == 1, F.log(sens / (1 - spec))).otherwise(F.log((1 - sens) / spec))
    share = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("share")))
    weighed = joined.withColumn("weight", weight).select("class", "item", "annotator", "says", "told", "share", "weight")
    return (
        _with_totals(weighed, F.col("weight"))
        .withColumn("total", F.col("total") + F.log(share / (1 - share)))
        .select("class", "item", "annotator", "says", F.col("told").alias("before"), (1 / (1 + F.exp(-(F.col("total") - F.col("weight"))))).alias("told"), (1 / (1 + F.exp(-F.col("total")))).alias("belief"))
    )


def agreement(labels: DataFrame) -> DataFrame:
    """One row for labels(item, annotator, label): items with at least two labels, their labels, the share of agreeing
    pairs (each item counts by its labels), the share expected by chance, and Krippendorff's alpha (nominal).

    Alpha is null if there is nothing to compare, or only one label occurs.
    """
    counts = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    per_item = counts.groupBy("item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")).where("n > 1")
    paired = counts.join(per_item.select("item"), "item", "left_semi")
    per_label = paired.groupBy("label").agg(F.sum("k").alias("k"))
    none = F.lit(None).cast("double")
    total = per_item.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), F.sum(F.col("same") / (F.col("n") - 1)).alias("same"), none.alias("by_chance"))
    chance = per_label.agg(F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("labels"), none.alias("same"), F.sum(F.col("k") * (F.col("k") - 1)).cast("double").alias("by_chance"))
    both = total.unionByName(chance).agg(F.max("items").alias("items"), F.max("labels").alias("labels"), F.max("same").alias("same"), F.max("by_chance").alias("by_chance"))
    observed = F.try_divide(F.col("same"), F.col("labels"))
    expected = F.try_divide(F.col("by_chance"), F.col("labels") * (F.col("labels") - 1))
    return both.select("items", "labels", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, 1 - (1 - observed) / (1 - expected)).alias("alpha"))


# Wordings of verdicts that count.
DEFECTIVE_WORDS = ["defective", "不一致", "有缺陷", "inconsistent"]
CONSISTENT_WORDS = ["consistent", "一致", "无缺陷", "无缺陷的", "no defect"]


def pair_labels(pairs: DataFrame, verdicts: DataFrame, second: DataFrame) -> DataFrame:
    """Labels (item = pair_id, annotator, label) of participants and second annotators on the pairs.

    Spellings of a participant are one person; empty, null and non-committal verdicts do not count; the latest per
    person and pair does. Verdicts on unknown pairs are left out.
    """
    key = ["project", "req_id", "file", "method_name"]
    said = plain(F.col("verdict"))
    label = F.when(said.isin(DEFECTIVE_WORDS), "defective").when(said.isin(CONSISTENT_WORDS), "consistent")
    first = (
        verdicts.select(*key, F.concat(F.lit("participant:"), F.upper(plain(F.col("participant")))).alias("annotator"), label.alias("label"), F.col("end_time").cast("double").alias("at"))
        .where(F.col("label").isNotNull())
        .join(pairs.select(*key, F.col("pair_id").alias("item")).distinct(), key)
        .select("item", "annotator", "label", "at")
    )
    again = second.join(pairs.select("pair_id").distinct(), "pair_id", "left_semi").select(
        F.col("pair_id").alias("item"),
        F.concat(F.lit("second:"), plain(F.col("annotator"))).alias("annotator"),
        F.when(F.col("consistent"), "consistent").when(~F.col("consistent"), "defective").alias("label"),
        (F.unix_micros(F.col("generated_at").cast("timestamp")) / 1e6).alias("at"),
    )
    return latest_labels(first.unionByName(again))
