"""Scalar and score expressions: strings, parsers, entropies, weights, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def conjunction(conditions: list[Column]) -> Column:
    """All of a list of predicates; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def handle(text: Column) -> Column:
    """A user name as typed: trimmed, without leading @, lower case."""
    return F.lower(F.regexp_replace(F.trim(text), "^@+", ""))


def trimmed(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def first_known(*columns: Column) -> Column:
    """The first of several aliases of a field that holds something."""
    return F.coalesce(*[trimmed(c) for c in columns])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact_count(text: Column) -> Column:
    """A count as shown on a page ("90.5K Followers", "1,234"), as a whole number; null without digits."""
    number = F.regexp_extract(text, r"([0-9][0-9,]*\.?[0-9]*)\s*([KkMm]?)", 1)
    unit = F.upper(F.regexp_extract(text, r"([0-9][0-9,]*\.?[0-9]*)\s*([KkMm]?)", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    return F.when(number != "", F.floor(F.regexp_replace(number, ",", "").cast("double") * scale + 1e-6).cast("long"))


def bits_tag(tag: Column) -> Column:
    """``bits:NAME:+N`` as a struct (name, bits); null for other tags."""
    parts = F.split(tag, ":")
    bits = F.regexp_replace(F.element_at(parts, 3), r"^\+", "").try_cast("int")
    ok = (F.size(parts) == 3) & (F.lower(F.element_at(parts, 1)) == "bits") & (F.trim(F.element_at(parts, 2)) != "") & bits.isNotNull()
    return F.when(ok, F.struct(F.trim(F.element_at(parts, 2)).alias("name"), bits.alias("bits")))


def event_key(*parts: Column) -> Column:
    """sha1 of the parts joined by bars; a null part is empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def split_of(key: Column, train: int = 70, dev: int = 15) -> Column:
    """train, dev or test by the first 32 bits of the key's sha256, for ever the same."""
    at = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(at < train, "train").when(at < train + dev, "dev").otherwise("test")


def entropy(weights: Column, base: float | None = None, normalise: bool = True, by: Column | None = None) -> Column:
    """Entropy of an array of weights, which are made to sum to 1 first if ``normalise``.

    In nats, or by ``base``; divided by the logarithm of ``by`` (number of classes) if given, 0 where that is 1 or less."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    p = F.transform(weights, lambda x: F.coalesce(x, F.lit(0.0)) / total) if normalise else weights
    h = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    h = F.when(total > 0, h).otherwise(0.0) if normalise else h
    if base:
        h = h / F.ln(F.lit(base))
    if by is not None:
        scale = F.ln(by.cast("double")) / (F.ln(F.lit(base)) if base else F.lit(1.0))
        h = F.when(by > 1, h / scale).otherwise(0.0)
    return h


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def total_variation(a: Column, b: Column) -> Column:
    """Half the sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x) / 2


def queue_score(uncertainty: Column, disagreement: Column) -> Column:
    return 0.7 * uncertainty + 0.3 * disagreement


def decay(age: Column, half_life: float) -> Column:
    """1 at age 0 (or less), a half after each half-life."""
    return F.exp(-F.lit(LN2) * F.greatest(age, F.lit(0.0)) / F.lit(float(half_life)))


def engagement_rate(likes: Column, posts: Column, followers: Column) -> Column:
    zero = F.lit(0)
    return (F.coalesce(likes, zero) + F.coalesce(posts, zero)) / F.greatest(F.coalesce(followers, zero), F.lit(1))


def path_score(distance: Column, most: int = 3) -> Column:
    """1 next door, falling to 0.1 at the greatest distance, 0 beyond or without a path."""
    step = 0.9 / (most - 1) if most > 1 else 0.0
    return F.when(distance <= most, 1 - (distance - 1) * F.lit(step)).otherwise(0.0)


# Fixed values of the bands: least weight and greatest entropy of a specialist; least weight and number of classes and
# greatest none weight of a bridge; least weight of the frontier; first for weights that sum to 1, then for lifts.
BANDS = {False: (0.30, 0.70, 0.15, 2, 0.40, 0.08), True: (5.0, 0.70, 2.5, 2, 999.0, 1.5)}


def band(weights: Column, none: Column, classes: int, labelled: Column, abstain: Column, independent: bool = False, neighbours: Column | None = None) -> Column:
    """The band of an account from its array of class weights: exemplar for labelled ones, then specialist, bridge, frontier, unknown.

    ``independent``: weights are lifts, and a class counts for a bridge only with a labelled
    neighbour in ``neighbours`` (an array in the order of the weights), if that is given."""
    least, sure, bridge, several, most_none, known = BANDS[independent]
    top = F.array_max(weights)
    held = F.transform(weights, lambda w: w >= bridge)
    if independent and neighbours is not None:
        held = F.zip_with(held, neighbours, lambda a, n: a & (n >= 1))
    h = entropy(F.transform(weights, lambda w: F.when(w > 1e-10, w).otherwise(0.0)), normalise=False, by=F.lit(classes))
    return (
        F.when(labelled, "exemplar")
        .when(abstain, "unknown")
        .when((top >= least) & (h < sure), "specialist")
        .when((F.size(F.filter(held, lambda a: a)) >= several) & (none < most_none), "bridge")
        .when(top >= known, "frontier")
        .otherwise("unknown")
    )


def info_value(uncertainty: Column, degree: Column, none: Column) -> Column:
    return uncertainty * F.sqrt(F.greatest(degree, F.lit(1))) * (1 - none)


def relevance(none: Column, entropy_: Column, concentration: Column, degree: Column, median_degree: Column) -> Column:
    return (1 - none) * (1 - entropy_) * concentration * F.least(F.lit(1.0), F.ln(1 + degree) / F.ln(1 + median_degree))


def enrichment_discount(samples: Column, archived: Column, full: int = 50) -> Column:
    """1 for archived accounts; for others the root of how much of a full sample there is."""
    return F.when(archived, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(samples / F.lit(float(full)))))


def seed_concentration(total: Column, entropy_: Column, floor: float = 0.05, full: float = 50.0) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), F.sqrt(total / F.lit(full))) * (1 - entropy_))


def eligible(weight: Column, content_agrees: Column, least: float = 0.25, sure: float = 0.4) -> Column:
    return (weight >= least) & ~(~content_agrees & (weight < sure))


def confidence(richness: Column, labelling: Column, concentration: Column, network: Column, agreement: Column) -> Column:
    return 0.25 * richness + 0.30 * labelling + 0.20 * concentration + 0.15 * network + 0.10 * agreement


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("minimal")


def acquisition(entropy_: Column, boundary: Column, influence: Column, novelty: Column, coverage: Column) -> Column:
    return 0.35 * entropy_ + 0.25 * boundary + 0.20 * influence + 0.15 * novelty + 0.05 * coverage


def labelling_profile(total_bits: Column) -> Column:
    return F.when(total_bits == 0, "no_signal").when(total_bits > 40, "high").otherwise("ambiguous")


def valid_distribution(weights: Column, tolerance: float = 1e-3) -> Column:
    """Why an array of probabilities is not one, or null."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.exists(weights, lambda x: x.isNull()), "missing").when(F.exists(weights, lambda x: (x < 0) | (x > 1)), "out of range").when(F.abs(total - 1) > tolerance, "sum")


def export_confidence(seed_neighbours: Column, top: Column, none: Column, entropy_: Column) -> Column:
    return F.round(F.when(seed_neighbours > 0, F.least(F.lit(1.0), seed_neighbours / 20)).otherwise(top * (1 - none) * (1 - entropy_)), 3)


def shrunk(p: Column, coverage: Column, prior: float, uncertainty: Column) -> Column:
    """A membership drawn to the prior where coverage is thin: struct (p, uncertainty, low, high)."""
    q = p * coverage + F.lit(prior) * (1 - coverage)
    u = 0.7 * uncertainty + 0.3 * (1 - coverage)
    half = 1.96 * F.least(F.lit(0.25), 0.25 * u)
    return F.struct(q.alias("p"), u.alias("uncertainty"), clip(q - half, 0.0, 1.0).alias("low"), clip(q + half, 0.0, 1.0).alias("high"))


def refresh_reason(first: Column, small_gap: Column, capture: Column, stored: Column, claimed: Column, age_days: Column) -> Column:
    """Why a list is fetched again; the first rule that holds."""
    return F.when(first, "first run").when(small_gap, "small account").when(capture < 0.5, "low capture").when(stored > claimed, "store mismatch").when(age_days > 180, "age").when(F.abs(claimed - stored) > 0.5 * stored, "changed").otherwise("fresh")


def weights_normalised(weights: dict[str, float], defaults: dict[str, float]) -> dict[str, float]:
    """Weights clamped to [0, 1] that sum to 1; the defaults if nothing is left."""
    kept = {k: min(1.0, max(0.0, float(weights.get(k, 0.0)))) for k in defaults}
    total = sum(kept.values())
    return {k: round(v / total, 4) for k, v in kept.items()} if total else dict(defaults)
