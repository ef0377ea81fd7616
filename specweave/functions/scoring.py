"""Scores of retrieval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking.
RRF_K = 60
BOOST_PRODUCT, BOOST_TEST_METHODS, BOOST_CERTIFIED, BOOST_RECENT = 0.06, -0.03, 0.03, 0.02
RECENCY_FLOOR = 1980
MAX_BOOST = BOOST_PRODUCT + BOOST_CERTIFIED + BOOST_RECENT
HIGH, RELATED = 0.95, 0.82
SCORE_CITED, SCORE_CITED_PART = 1.0, 0.95


def rrf(rank: Column) -> Column:
    """Reciprocal rank share; ranks start at 0."""
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank)


def relevance(score: Column, retrievers: int) -> Column:
    """Fused score against the best that any document could have, in single precision."""
    return (score / F.lit(max(retrievers, 1) / RRF_K)).cast("float").cast("double")


def boost(aspect: Column, certified: Column, year: Column, this_year: int) -> Column:
    """Metadata boost; what is not known costs nothing."""
    a = F.lower(F.trim(F.coalesce(aspect, F.lit(""))))
    kind = F.when(a == "product specification", BOOST_PRODUCT).when(a.startswith("methods of test"), BOOST_TEST_METHODS).otherwise(0.0)
    span = max(this_year - RECENCY_FLOOR, 1)
    recent = F.when(year > RECENCY_FLOOR, F.lit(BOOST_RECENT) * F.least((year - RECENCY_FLOOR) / span, F.lit(1.0))).otherwise(0.0)
    return kind + F.when(F.coalesce(certified, F.lit(False)), BOOST_CERTIFIED).otherwise(0.0) + recent


def combine(rel: Column, boosted: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rel * (1 + boosted) / (1 + MAX_BOOST)))


def tier(score: Column, high: float = HIGH, related: float = RELATED) -> Column:
    return F.when(score >= high, "Highly relevant").when(score >= related, "Related").otherwise("Possibly relevant")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of set sizes, to four places; inputs are distinct."""
    return F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)), 4)
