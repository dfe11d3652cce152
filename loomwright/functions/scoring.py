"""Scoring arithmetic as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringParams:
    """Weights of the semantic, constraint and invariant score, thresholds, and the risk gate."""

    alpha: float
    beta: float
    gamma: float
    t1: float
    t2: float
    risk_gate: float = 0.35
    risk_weight: float = 0.55

    def __post_init__(self):
        if not all(0 <= w <= 1 for w in (self.alpha, self.beta, self.gamma)) or abs(self.alpha + self.beta + self.gamma - 1) > 0.01:
            raise ValueError("weights must lie in 0..1 and add up to 1")
        if self.t1 <= self.t2:
            raise ValueError("t1 must be greater than t2")


CALIBRATED = ScoringParams(0.5, 0.2, 0.3, 0.52, 0.5)
LEGACY = ScoringParams(0.4, 0.35, 0.25, 0.8, 0.5)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mapped_cosine(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """(1 + cosine) / 2, or null unless both norms are positive."""
    return F.when((norm_a > 0) & (norm_b > 0), (1 + product / (norm_a * norm_b)) / 2)


def raw_similarity(semantic: Column, constraint: Column, invariant: Column, p: ScoringParams) -> Column:
    return p.alpha * semantic + p.beta * constraint + p.gamma * invariant


def penalised(raw: Column, risk: Column, p: ScoringParams) -> Column:
    return raw * (1 - risk * p.risk_weight)


def status(total: Column, risk: Column, p: ScoringParams) -> Column:
    """consistent strictly above t1 unless the risk reaches its gate, general from t2, else serious."""
    return F.when((total > p.t1) & (risk < p.risk_gate), "consistent").when(total >= p.t2, "general").otherwise("serious")


def sub_type(semantic: Column, constraint: Column, invariant: Column) -> Column:
    return F.when(constraint < 0.6, "constraint").when(invariant < 0.7, "invariant").when(semantic < 0.2, "semantic").otherwise(F.when(invariant < constraint, "mismatch_invariant").otherwise("mismatch_constraint"))


def calibrated(x: Column, kind: str, center: float = 0.5, width: float = 0.1, lo: Column | None = None, hi: Column | None = None) -> Column:
    """linear: clamped; sigmoid: logistic around center (a width not above 0 counts as 0.05, the argument is held within 30);
    minmax: within lo..hi, unchanged where they differ by less than 0.001."""
    if kind == "linear":
        return clamp(x)
    if kind == "sigmoid":
        z = clamp((x - center) / (width if width > 0 else 0.05), -30.0, 30.0)
        return 1 / (1 + F.exp(-z))
    return F.when(hi - lo < 1e-3, x).otherwise((x - lo) / (hi - lo))


def numeric_penalty(a: Column, b: Column) -> Column:
    """0.45 of the relative distance of the smallest positive numbers of both sides; 0 where one has none."""
    least = lambda c: F.array_min(F.filter(c, lambda v: v > 0)).cast("double")
    x, y = least(a), least(b)
    return F.when(x.isNull() | y.isNull(), 0.0).otherwise(0.45 * (1 - F.least(x, y) / F.greatest(x, y)))


def coverage_penalty(wanted: Column, there: Column) -> Column:
    """0, 0.2 or 0.4 by the share of wanted elements that are there (from two thirds, one third, below)."""
    share = F.size(F.array_intersect(wanted, there)) / F.size(F.array_distinct(wanted))
    return F.when(F.size(wanted) == 0, 0.0).when(share >= 0.66, 0.0).when(share >= 0.33, 0.2).otherwise(0.4)


def state_penalty(wanted: Column, there: Column) -> Column:
    """0.45 where the code has less than half of the wanted states."""
    share = F.size(F.array_intersect(wanted, there)) / F.size(F.array_distinct(wanted))
    return F.when((F.size(wanted) == 0) | (share >= 0.5), 0.0).otherwise(0.45)


# Risks from which rules decide between two verdicts, and overturn two that agree; similarity from which a
# single verdict of inconsistency does not count.
ARBITER_RISK, VETO_RISK, SIMILARITY_GATE = 0.30, 0.45, 0.70


def merged_verdict(a: Column, b: Column, rule_risk: Column, bound_risk: Column) -> Column:
    """(consistent, path) of two verdicts, each true for consistent or null for none.

    Two that agree hold, two that differ are settled by the rules' risk; then a bound that the code misses overturns a
    verdict of consistency. One verdict alone stands. Without any both are null.
    """
    detected = F.when(a == b, ~a).otherwise(rule_risk >= ARBITER_RISK)
    path = F.when(a == b, F.when(a, "LLM_CONSENSUS_CONSISTENT").otherwise("LLM_CONSENSUS_DEFECT")).otherwise(F.when(detected, "LLM_ARBITRATION_DEFECT").otherwise("LLM_ARBITRATION_KEEP"))
    veto = ~detected & (bound_risk >= VETO_RISK)
    both = a.isNotNull() & b.isNotNull()
    one = F.coalesce(a, b)
    return F.struct(
        F.when(both, ~(detected | veto)).otherwise(one).alias("consistent"),
        F.when(both, F.when(veto, "RULE_QUANTIFY_VETO").otherwise(path)).when(one.isNotNull(), "LLM_SINGLE").alias("path"),
    )


def gated_verdict(consistent: Column, total: Column) -> Column:
    """(consistent, path) of a single verdict: inconsistency does not count from a similarity of SIMILARITY_GATE on."""
    gate = ~consistent & (total >= SIMILARITY_GATE)
    return F.struct((consistent | gate).alias("consistent"), F.when(gate, "LLM_SIM_GATE").when(consistent.isNotNull(), "LLM_SINGLE").alias("path"))


def written_back(consistent: Column, path: Column, total: Column, t2: Column, status: Column) -> Column:
    """(status, path) that a verdict writes back; without one the rules' status stays."""
    after = F.when(consistent.isNull(), status).when(consistent, "consistent").when(total < t2, "serious_inconsistent").otherwise("general_inconsistent")
    return F.struct(after.alias("status"), F.when(consistent.isNull(), "RULE_FALLBACK").otherwise(F.coalesce(path, F.lit("LLM"))).alias("path"))


def health(coverage: Column, defects: Column, status_score: Column) -> Column:
    """0..100 from coverage (0..1, null where never analysed), number of defects and a status score."""
    clean = F.greatest(F.lit(0.0), 100.0 - 8.0 * defects)
    return F.when(coverage.isNull(), F.floor(0.55 * clean + 0.45 * status_score + 0.5)).otherwise(F.floor(55.0 * coverage + 0.25 * clean + 0.2 * status_score + 0.5))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D")


# Weights of risk signals that differ from 1.
RISK_WEIGHTS = {"state": 0.0, "numeric": 2.0, "bound": 1.5}


def risk(signals: dict[str, Column]) -> Column:
    """Weighted sum of signals, held within 0..0.65."""
    return clamp(sum((RISK_WEIGHTS.get(k, 1.0) * c for k, c in signals.items()), F.lit(0.0)), 0.0, 0.65)
