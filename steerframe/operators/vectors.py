"""Vector operators: steering, rotation, softmax, draws and cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from steerframe.functions import blocks, noise as ns, vectors as vx
from steerframe.operators.skew import attach
from steerframe.schemas import require

# Default steering weights of hidden layers and of the final scores.
DEFAULT_WEIGHT = 0.3
DEFAULT_SCORE_WEIGHT = 0.0

# Fixed value: leading positions that are never changed.
SINK = 6

# Sites whose positions are those of the current chunk, and sites
# that hold past and current positions together.
CHUNK_SITES = ("h", "q_in", "a_ho")
WHOLE_SITES = ("k_all", "v_all")


def steering_shift(
    vectors: DataFrame,
    group: list[str],
    batch_idx: str = "batch_idx",
    numpos: str = "numpos",
    numneg: str = "numneg",
    vec: str = "vec",
    dim: int | None = None,
) -> DataFrame:
    """Per group: mean of its negative vectors minus its lead vector.

    The difference is linear in the rows, so one weighted vector sum gives it: a
    negative counts 1/numneg, the lead -1. That sum is combined on the map side and
    shuffles one vector per group and task. Groups without negatives, without their lead
    or without all ``numneg`` negatives are absent. ``dim`` is the vectors' length, if
    known; vectors of another length then fail the query.
    """
    is_negative = (F.col(batch_idx) >= F.col(numpos)) & (
        F.col(batch_idx) < F.col(numpos) + F.col(numneg)
    )
    is_lead = F.col(batch_idx) == 0
    zero = F.lit(0.0)
    part = F.when(is_negative, F.lit(1.0) / F.col(numneg)).otherwise(zero) - F.when(
        is_lead, F.lit(1.0)
    ).otherwise(zero)
    rows = vectors.filter((F.col(numneg) > 0) & (is_lead | is_negative))
    shift, length = F.col("shift"), F.size(vec)
    if dim is not None:
        wrong = (F.col("_shortest") != dim) | (F.col("_longest") != dim)
        error = F.raise_error(F.lit(f"vectors to steer are not {dim} long"))
        shift = F.when(wrong, error.cast("array<double>")).otherwise(shift)
    return (
        rows.withColumn("_part", part)
        .groupBy(*group)
        .agg(
            vx.weighted_sum(vec, "_part", dim).alias("shift"),
            F.count_if(is_lead).alias("_leads"),
            F.count_if(is_negative).alias("_negatives"),
            F.max(numneg).alias("_expected"),
            F.min(length).alias("_shortest"),
            F.max(length).alias("_longest"),
        )
        .filter((F.col("_leads") == 1) & (F.col("_negatives") == F.col("_expected")))
        .select(*group, shift.alias("shift"))
    )


def steer_from_negatives(
    vectors: DataFrame,
    group: list[str],
    weight: Column | float = DEFAULT_WEIGHT,
    batch_idx: str = "batch_idx",
    numpos: str = "numpos",
    numneg: str = "numneg",
    vec: str = "vec",
    dim: int | None = None,
) -> DataFrame:
    """Shift every vector of a group away from the mean of the group's negatives.

    All rows move, negatives and extra positives included, by
    ``weight * (mean(negatives) - lead)``; a group without negatives stays as it is,
    and so does one that lacks its lead or some of its negatives.
    """
    require(vectors, [*group, batch_idx, numpos, numneg, vec], "steer_from_negatives")
    shifts = steering_shift(vectors, group, batch_idx, numpos, numneg, vec, dim)
    joined = attach(vectors, shifts, group)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return joined.withColumn(
        vec,
        F.when(F.col("shift").isNull(), F.col(vec)).otherwise(
            vx.subtract_scaled(F.col(vec), F.col("shift"), w)
        ),
    ).drop("shift")


def select_span(
    df: DataFrame,
    site: str = "site",
    pos: str = "pos",
    past_len: str = "past_len",
    chunk_len: str = "chunk_len",
    protect: str = "protect",
    out: str = "in_span",
) -> DataFrame:
    """Flag the positions that may change.

    The first positions of a sequence are kept. With protection on, whole-sequence
    sites change only what came before the chunk, and chunk sites only position 0.
    """
    require(df, [site, pos, past_len, chunk_len, protect], "select_span")
    past, chunk = F.col(past_len), F.col(chunk_len)
    whole = F.col(site).isin(*WHOLE_SITES)
    start = (
        F.when(past < SINK, F.lit(SINK) - past).when(whole, F.lit(SINK)).otherwise(F.lit(0))
    )
    end = (
        F.when(whole, F.when(F.col(protect), past).otherwise(past + chunk))
        .when(F.col(protect), F.lit(1))
        .otherwise(chunk)
    )
    return df.withColumn(out, (F.col(pos) >= start) & (F.col(pos) < end))


def rotate_random(
    df: DataFrame,
    theta: Column | float,
    key: Column,
    seed: int,
    vec: str = "vec",
    out: str = "vec",
    noise: ns.Noise = ns.HASHED,
) -> DataFrame:
    """Rotate each vector by a random angle in [0, theta) towards a random direction.

    ``key`` is an integer that identifies the row (a hash of several columns will do).
    """
    require(df, [vec], "rotate_random")
    theta = theta if isinstance(theta, Column) else F.lit(float(theta))
    return df.withColumn(out, blocks.rotated(F.col(vec), theta, key, seed, noise))


def angle_audit(
    df: DataFrame, before: str, after: str, theta: float, group: list[str] | None = None
) -> DataFrame:
    """Mean angle between two vector columns, and its ratio to the expected theta/2."""
    require(df, [before, after, *(group or [])], "angle_audit")
    angles = df.select(*(group or []), vx.angle(F.col(before), F.col(after)).alias("_angle"))
    return angles.groupBy(*(group or [])).agg(
        F.round(F.avg("_angle"), 5).alias("mean_angle"),
        F.round(F.avg("_angle") / F.lit(theta / 2), 2).alias("ratio"),
    )


def angle_audit_tables(
    before: DataFrame, after: DataFrame, key: list[str], theta: float, vec: str = "vec"
) -> DataFrame:
    """``angle_audit`` of two tables that share a unique key."""
    both = before.select(*key, F.col(vec).alias("_before")).join(
        after.select(*key, F.col(vec).alias("_after")), key
    )
    return angle_audit(both, "_before", "_after", theta)


# Width of one score band in group_softmax; exp() of it is far from overflow.
_BAND = 32


def log_partition(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Per group: log of the sum of exp(score).

    Scores are summed in bands of width 32, each relative to its own base, so the
    sum is safe for any score and needs a single pass that combines on the map
    side; only one row per group and band is left to put together. A score of minus
    infinity weighs nothing; a group of such scores alone has a null logarithm.
    """
    masked = F.col(score).cast("double") == F.lit(float("-inf"))
    # a double, so that no score is out of range
    band = F.rint(F.when(~masked, F.col(score).cast("double")) / F.lit(float(_BAND)))
    banded = df.groupBy(*group, band.alias("_band")).agg(
        F.sum(F.exp(F.col(score) - band * F.lit(_BAND))).alias("_sum"),
    )
    top = F.max("_band").over(Window.partitionBy(*group))
    weighted = banded.withColumn("_top", top).withColumn(
        "_sum", F.col("_sum") * F.exp((F.col("_band") - F.col("_top")) * F.lit(_BAND))
    )
    return weighted.groupBy(*group).agg(
        (F.first("_top") * F.lit(_BAND) + F.ln(F.sum("_sum"))).alias("log_z"),
    )


def group_softmax(
    df: DataFrame,
    group: list[str],
    score: str,
    out: str = "weight",
) -> DataFrame:
    """exp(score) divided by its group's sum, safe for scores of any size."""
    require(df, [*group, score], "group_softmax")
    joined = attach(df, log_partition(df, group, score), group)
    share = F.exp(F.col(score) - F.col("log_z"))
    unseen = F.col("log_z").isNull() & F.col(score).isNotNull()
    return joined.withColumn(out, F.when(unseen, F.lit(0.0)).otherwise(share)).drop("log_z")


def weighted_draw(
    candidates: DataFrame,
    group: list[str],
    candidate: str,
    score: str,
    seed: int,
    noise: ns.Noise = ns.HASHED,
    key: Column | None = None,
) -> DataFrame:
    """Draw one candidate per group with probability softmax(score).

    The largest of score plus Gumbel noise follows that law, so the draw is one
    ``max_by``, combined on the map side, with no running sum over sorted rows.
    """
    require(candidates, [*group, candidate, score], "weighted_draw")
    key = F.struct(*group) if key is None else key
    u = noise.column(key, F.col(candidate), seed)
    # u may be 0, where the logarithm has no value
    gumbel = -F.ln(-F.ln(F.greatest(u, F.lit(2.0**-54))))
    return candidates.groupBy(*group).agg(
        F.max_by(F.col(candidate), F.col(score) + gumbel).alias(candidate)
    )


def split_vec(df: DataFrame, heads: int, vec: str = "vec") -> DataFrame:
    """One row per head: ``head`` and its part of the vector."""
    require(df, [vec], "split_vec")
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, F.posexplode_outer(vx.split(F.col(vec), heads)).alias("head", vec))


def concat_vec(
    df: DataFrame, key: list[str], head: str = "head", vec: str = "vec"
) -> DataFrame:
    """The inverse of ``split_vec``; (key, head) is unique, so a list holds one vector."""
    require(df, [*key, head, vec], "concat_vec")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(head), F.col(vec).alias("v"))))
    return (
        df.groupBy(*key)
        .agg(ordered.alias("_parts"))
        .withColumn(vec, F.flatten(F.transform("_parts", lambda p: p["v"])))
        .drop("_parts")
    )


def last_position(df: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """The row of the highest position per key, in one map-side combined aggregate."""
    require(df, [*key, pos], "last_position")
    rest = [c for c in df.columns if c not in key and c != pos]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(pos, *rest), F.col(pos)).alias("_last"))
        .select(*key, "_last.*")
    )


# Fixed value: a label that the loss leaves out.
IGNORED_LABEL = -100


def shifted_xent(
    scores: DataFrame,
    labels: DataFrame,
    key: list[str],
    pos: str = "pos",
    score_vec: str = "scores",
    label: str = "label",
    group: list[str] | None = None,
) -> DataFrame:
    """Mean cross-entropy of the scores at a position against the label one further on.

    The join key is (key, position), unique on both sides, so a long sequence spreads
    over all tasks. Ignored and null labels are left out; any other label that is no place
    of the scores fails the query.
    """
    require(scores, [*key, pos, score_vec], "shifted_xent")
    require(labels, [*key, pos, label], "shifted_xent")
    targets = labels.filter(F.col(label) != IGNORED_LABEL).select(
        *key, (F.col(pos) - 1).alias(pos), F.col(label).alias("_target")
    )
    outside = (F.col("_target") < 0) | (F.col("_target") >= F.size(score_vec))
    losses = scores.join(targets, [*key, pos]).select(
        *(group or []),
        F.when(outside, F.raise_error(F.lit("label outside the scores")).cast("double"))
        .otherwise(
            vx.log_sum_exp(F.col(score_vec)) - F.get(F.col(score_vec), F.col("_target"))
        )
        .alias("_loss"),
    )
    return losses.groupBy(*(group or [])).agg(
        F.avg("_loss").alias("loss"), F.count("_loss").alias("n")
    )
