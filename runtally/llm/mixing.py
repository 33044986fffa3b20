"""Mixing sources to target weights with soft memberships.

A labelled table (document, domain) trains a naive Bayes classifier on hashed words; it gives
every document a posterior over the domains. Rates ``r >= 0`` per document are fitted so that
the expected tokens per domain, ``sum r n p_d``, match the targets:

    minimise  sum_d ((sum_i r_i n_i p_id - T_d) / N)^2  +  ridge * sum_i (n_i / N) (r_i - 1)^2

A rate is 1 less the pull of its document's gaps, ``r = max(0, 1 - p . g / ridge)``, where the
solution's gaps g are the least of a convex function of as many unknowns as there are domains.
A damped Newton descent finds them and ends when the gaps that its rates leave differ from g by
``tolerance`` at most, that is when the projected gradient vanishes; it fails if it does not get
there. Posteriors are rounded to the nearest of ``STEPS`` steps, and documents with one posterior
are one cell; each iteration sums over the stored cells and only totals reach the driver.

The ridge keeps rates near 1 and so leaves a part of a rare domain's gap open: ``reached`` tells
what the rates give, and the fit logs it.

Built-in functions only. Labels are sampled: at most ``per_domain`` documents of each domain
(the lowest hashes of the id); that bounds the training join's broadcast side.

Defined results: null, empty and blank texts have no tokens and the prior as posterior; null
labels, labels of unknown domains or documents teach nothing; repeated rows are documents of
their own; a domain without labels keeps a smoothed prior; if there are no tokens, every rate
is 1; result columns replace input columns of the same name, others are carried along; an
empty table gives an empty table.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runtally.session import materialize

PER_DOMAIN, BUCKETS, SMOOTHING = 3000, 1 << 14, 0.5
#: Words that a text's evidence counts as, at most; steps of a posterior.
EVIDENCE, STEPS = 250.0, 1 << 16
RIDGE, ITERATIONS, TOLERANCE = 0.001, 40, 1e-5
#: The least ridge that a fit works with, and halvings of a step before it counts as failed.
LEAST_RIDGE, HALVINGS = 1e-9, 40

log = logging.getLogger(__name__)


def _buckets(text: Column) -> Column:
    """Bucket numbers (from 1) of the lower-cased words of a text."""
    words = F.split(F.trim(F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\t\n\x0b\x0c\r", "     ")), " +")
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1
    return F.when(words != F.array(F.lit("")), F.transform(words, bucket)).otherwise(F.array().cast("array<int>"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator: what is built on them does not compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _numbers(values: list[float]) -> Column:
    """A constant array, as one expression."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


class Classifier:
    def __init__(self, domains: list[str], priors: list[float], weights: list[list[float]]):
        self.domains, self.priors, self.weights = domains, priors, weights

    def logs(self, buckets: Column) -> Column:
        """array<double>: the log of each domain's posterior, but for a common summand."""
        n = F.size(buckets)
        weight = F.when(n > 0, F.least(F.lit(EVIDENCE), n.cast("double")) / n).otherwise(0.0)
        return F.array(
            *(F.lit(prior) + weight * _sum(buckets, _numbers(table)) for prior, table in zip(self.priors, self.weights))
        )


def _sum(buckets: Column, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table, b - 1))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], doc_id: str, text: str, per_domain: int) -> Classifier:
    """``labels``: doc_id, domain."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("domain").cast("string")).where(F.col("doc_id").isNotNull())
    some = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        some = part if some is None else some.unionAll(part)
    # At most domains x per_domain rows: a proven bound for the broadcast.
    taught = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    taught = materialize(taught.select("domain", _buckets(F.col("text")).alias("buckets")), "taught")
    counts = taught.select("domain", F.explode("buckets").alias("bucket")).groupBy("domain", "bucket").count()
    table = {d: [SMOOTHING] * BUCKETS for d in domains}
    for row in counts.toLocalIterator():  # domains x BUCKETS rows at most
        table[row["domain"]][row["bucket"] - 1] += row["count"]
    # Priors are the shares of the whole label table, not of the sample.
    sizes = {r["domain"]: r["count"] for r in known.where(F.col("domain").isin(domains)).groupBy("domain").count().collect()}
    whole = sum(sizes.values()) + len(domains)
    priors = [math.log((sizes.get(d, 0) + 1) / whole) for d in domains]
    weights = []
    for d in domains:
        total = math.log(sum(table[d]))
        weights.append([math.log(x) - total for x in table[d]])
    return Classifier(domains, priors, weights)


def _rounded(logs: Column) -> Column:
    """Softmax in nearest steps; what rounding leaves goes to the likeliest (the first at a tie)."""
    top = F.array_max(logs)
    grown = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda acc, x: acc + x)
    nearest = F.transform(grown, lambda x: F.floor(x / total * STEPS + 0.5).cast("double") / STEPS)
    left = F.lit(1.0) - F.aggregate(nearest, F.lit(0.0), lambda acc, x: acc + x)
    best = F.array_position(logs, top)
    return F.transform(nearest, lambda x, k: x + F.when(k + 1 == best, left).otherwise(0.0))


def _rates(p: Column, gaps: list[float], ridge: float) -> Column:
    """The rate of a posterior where the solution leaves ``gaps``."""
    pull = F.lit(0.0)
    for k, g in enumerate(gaps):
        pull = pull + p[k] * F.lit(g)
    return F.greatest(F.lit(0.0), F.lit(1.0) - pull / F.lit(ridge))


def fit(cells: DataFrame, targets: list[float], ridge: float, iterations: int, tolerance: float) -> list[float]:
    """The gaps of the best rates for ``cells`` (p, tokens); targets are shares.

    ``iterations``: at most so many Newton steps, ``tolerance``: bound of the projected gradient.
    """
    width = len(targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return [0.0] * width
    p, goal = F.col("p"), np.array(targets)
    pairs = [(k, j) for k in range(width) for j in range(k, width)]

    def at(g: np.ndarray):
        """The value, gradient and curvature of the convex function."""
        rated = _once(cells.select("p", "tokens"), r=_rates(p, g.tolist(), ridge))
        moving = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        sums = rated.agg(
            F.sum(F.col("tokens") * F.col("r") * F.col("r")),
            *(F.sum(F.col("tokens") * F.col("r") * p[k]) for k in range(width)),
            *(F.sum(moving * p[k] * p[j]) for k, j in pairs),
        ).first()
        value = (g @ g + ridge * sums[0] / total) / 2 + goal @ g
        curved = np.eye(width)
        for (k, j), x in zip(pairs, sums[1 + width :]):
            curved[k, j] += x / total / ridge
            if k != j:
                curved[j, k] += x / total / ridge
        return value, g + goal - np.array(sums[1 : 1 + width]) / total, curved

    g = np.zeros(width)
    value, slope, curved = at(g)
    for _ in range(iterations):
        if np.abs(slope).max() <= tolerance:
            break
        step, size = np.linalg.solve(curved, slope), 1.0
        for _ in range(HALVINGS):
            new = at(g - size * step)
            # near the end values differ by rounding alone: a smaller gradient counts, too
            if new[0] <= value - 1e-4 * size * (slope @ step) or np.abs(new[1]).max() < np.abs(slope).max() / 2:
                break
            size /= 2
        g, (value, slope, curved) = g - size * step, new
    left = np.abs(slope).max()
    if left > tolerance:
        raise RuntimeError(f"the rates have not converged: {left:.2e} is left after {iterations} iterations")
    log.info("shares less targets: %s", [float(x) for x in g])
    return g.tolist()


def reached(mixed: DataFrame, targets: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Per domain its target and the expected share (of all tokens) that the rates give."""
    whole = sum(targets.values())
    share = [F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[k]) for k in range(len(targets))]
    row = mixed.agg(F.sum("n_tokens"), *share).first()
    return {d: (t / whole, x / row[0] if row[0] else 0.0) for (d, t), x in zip(targets.items(), row[1:])}


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    per_domain: int = PER_DOMAIN,
    ridge: float = RIDGE,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Add ``n_tokens``, ``posterior`` (array in the order of ``targets``) and ``rate``.

    ``targets``: the wanted share of all tokens per domain, nonnegative with a positive sum;
    ``keep``: the columns to carry along (all by default).
    """
    domains = list(targets)
    whole = sum(targets.values())
    if min(targets.values()) < 0 or whole <= 0:
        raise ValueError("targets must be nonnegative with a positive sum")
    model = train(docs, labels, domains, doc_id, text, per_domain)
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "posterior", "rate")]
    worded = docs.select(*(docs[c] for c in carried), F.inline(F.array(F.struct(_buckets(docs[text]).alias("__buckets")))))
    scored = _once(worded, __logs=model.logs(F.col("__buckets")), n_tokens=F.size("__buckets").cast("long"))
    judged = scored.select(*(scored[c] for c in carried), "n_tokens", _rounded(F.col("__logs")).alias("posterior"))
    judged = materialize(judged, "judged")
    cells = judged.groupBy(F.col("posterior").alias("p")).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    ridge = max(ridge, LEAST_RIDGE)
    gaps = fit(cells, [targets[d] / whole for d in domains], ridge, iterations, tolerance)
    return judged.withColumn("rate", _rates(F.col("posterior"), gaps, ridge))
