"""Column expressions shared by all operators."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of classes, in code order, and the no-answer code.
CLASS_NAMES = ["head-on", "rear-end", "t-bone", "sideswipe", "single"]
N_CLASSES = 5
BOT = -1

# Spelling variants and the class name each stands for.
CLASS_ALIASES = {
    "head_on": "head-on",
    "headon": "head-on",
    "rear_end": "rear-end",
    "rearend": "rear-end",
    "t_bone": "t-bone",
    "tbone": "t-bone",
    "t-bone/side": "t-bone",
    "side_swipe": "sideswipe",
    "side-swipe": "sideswipe",
    "single_vehicle": "single",
    "single-vehicle": "single",
}

# Tolerances on seconds, on score ties and on numerical zero.
TOL = 1e-9
TIE = 1e-9
ZERO = 1e-12


def uniform(key: Column, slot: int = 1) -> Column:
    """Uniform in [0, 1) from one of the four 32-bit words of ``md5(key)``.

    A draw depends on its key alone, so it is the same whatever the row order, the partitioning or
    the subset of rows, and a lost task recomputes the same value.
    """
    return word(F.md5(key), slot)


def word(digest: Column, slot: int) -> Column:
    """The same draw from a digest that is already a column, where several words of it are wanted."""
    return F.conv(F.substring(digest, 8 * (slot - 1) + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(key: Column) -> Column:
    """Standard normal draw by Box-Muller on two words of the key's digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(key, 1) + F.lit(1.0 / 4294967296.0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(key, 2))


def r6(c: Column | str) -> Column:
    """Rounded for reports, first to twelve places so that noise cannot decide a half; 0.0 is never -0.0."""
    return F.round(F.round(F.col(c) if isinstance(c, str) else c, 12), 6) + F.lit(0.0)


def sign_tol(c: Column, tol: float = ZERO) -> Column:
    """-1, 0 or 1, reading anything within ``tol`` of zero as zero; null stays null."""
    return F.when(c > tol, 1).when(c < -tol, -1).when(c.isNotNull(), 0)


def stable_delay(last_wrong: Column, steps: Column, delta: Column) -> Column:
    """Trapezoid area of "not yet stable" on a uniform grid ``0..steps``.

    An answer is stable at ``j`` exactly when ``j`` lies beyond the last wrong step, so the
    indicator is one step function and its trapezoid has a closed form.
    """
    return (
        F.when(last_wrong < 0, F.lit(0.0))
        .when(last_wrong >= steps, steps * delta)
        .otherwise((last_wrong + F.lit(0.5)) * delta)
    )


def trapezoid_weight(j: Column, steps: Column, delta: Column) -> Column:
    """Weight of grid point ``j`` in the trapezoid rule on ``0..steps``."""
    return (
        F.when(steps < 1, F.lit(0.0))
        .when((j == 0) | (j == steps), delta / 2)
        .otherwise(delta)
    )


def grid_steps(span: Column, delta: Column) -> Column:
    return F.floor(span / delta + TOL).cast("int")


def normal_class(raw: Column) -> Column:
    """Canonical class name of a free-text type; null when it is outside the closed set."""
    key = F.regexp_replace(F.lower(F.trim(raw)), " ", "")
    pairs = [F.lit(x) for item in CLASS_ALIASES.items() for x in item]
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    return F.when(name.isin(CLASS_NAMES), name)


def class_code(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CLASS_NAMES]), name) - 1).cast("int")


def wrong_class(code: Column, n_classes: int = N_CLASSES) -> Column:
    """The concrete wrong answer used by controls, so that wrong is not the same as no answer."""
    return F.pmod(code + 1, F.lit(n_classes)).cast("int")


def source_cluster(video_id: Column) -> Column:
    """Source recording of a clip: extension off, then every trailing ``_<1-3 digits>``.

    A name made of nothing but such parts keeps its first part, so the result is never empty.
    """
    stem = F.when(
        F.instr(F.substring_index(video_id, "/", -1), ".") > 0,
        F.regexp_replace(video_id, r"\.[^.]*$", ""),
    ).otherwise(video_id)
    return F.regexp_replace(stem, r"(?<=.)(_[0-9]{1,3})+$", "")


def mean_ratio(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is zero: undefined is not zero."""
    return F.when(den != 0, num / den)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary, instead of an error."""
    return mean_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
