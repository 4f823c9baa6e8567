"""Assignment of users to experiment variants and the readout.

Users are randomised, attempts are not: the attempts of one user share the user's
bank, device and luck. A rate over attempts is a ratio of two sums over users, and its
variance comes from how users scatter around that ratio (delta method). Five sums per
variant are enough for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded
from railpulse.operators.duplicates import completed_chain, repeats_completed
from railpulse.operators.neighbours import HOT_ROWS
from railpulse.operators.retries import retry_attempts

CONTROL, TREATMENT = "control", "treatment"
SALT = "smart-failure-v1"
# Salts of the A/A check.
AA_SALTS = [f"aa-{i}" for i in range(1, 201)]
# Quantiles of the normal distribution: two-sided 5 %, and power of 80 %.
Z_TWO_SIDED, Z_POWER = 1.959964, 0.841621
EXACT = "decimal(38,0)"


def bucket_of(user_id: Column, salt: str | Column = SALT) -> Column:
    """A stable bucket 0..99: the leading 32 bits of a salted SHA-256, modulo
    100. Every system that knows the salt finds the same bucket."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat(salt, F.lit(":"), user_id.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(100)


def variant_of(user_id: Column, salt: str | Column = SALT, treated_pct: int = 50) -> Column:
    return F.when(bucket_of(user_id, salt) < treated_pct, TREATMENT).otherwise(CONTROL)


def assign_variants(users: DataFrame, salt: str = SALT, treated_pct: int = 50) -> DataFrame:
    """Every user with the bucket and variant; a projection, no shuffle."""
    user = F.col("user_id")
    return users.select(
        "user_id",
        bucket_of(user, salt).cast("int").alias("bucket"),
        variant_of(user, salt, treated_pct).alias("variant"),
    )


def _moments(per_user: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums over users of ``whole``, ``part`` and their products, exact at any size."""
    products = {"ww": ("whole", "whole"), "pp": ("part", "part"), "wp": ("whole", "part")}
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("whole", "part")}
    return per_user.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("whole").alias("whole"),
        F.sum("part").alias("part"),
        *[F.sum(exact[a] * exact[b]).cast(EXACT).alias(name) for name, (a, b) in products.items()],
    )


def _side(side: str) -> dict[str, str]:
    """Rate of a variant, the variance of that rate, and what it would be if attempts were independent."""
    n, p, u = f"{side}_whole", f"{side}_rate", f"cast({side}_users as double)"
    scatter = f"cast({side}_pp as double) - 2D * {p} * cast({side}_wp as double) + {p} * {p} * cast({side}_ww as double)"
    return {
        p: f"{side}_part / nullif(cast({n} as double), 0D)",
        f"{side}_variance": f"{u} / nullif({u} - 1D, 0D) * greatest({scatter}, 0D) / nullif(cast({n} as double) * cast({n} as double), 0D)",
        f"{side}_naive": f"{p} * (1D - {p}) / nullif(cast({n} as double), 0D)",
    }


def ratio_readout(
    per_user: DataFrame,
    names: tuple[str, str, str],
    salt: str | Column = SALT,
    treated_pct: int = 50,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """A rate of both variants from (user_id, whole, part), a row per user.

    ``names`` are those of whole, part and rate in the result. The difference in points
    comes with its standard error, its 95 % interval, the z value and verdict at the
    5 % level, the design effect (how much wider than if attempts were independent)
    and the smallest difference found with a power of 80 %. One row, or one per
    combination of ``by``. What cannot be told from fewer than two users of a variant,
    or without any scatter, is NULL. With fewer than some hundred users the normal
    distribution is too narrow: on 40 users about one A/A test in ten looks significant.
    """
    whole, part, rate = names
    sides = _moments(per_user, *by, variant_of(F.col("user_id"), salt, treated_pct).alias("variant"))
    fields = ("users", "whole", "part", "ww", "pp", "wp")

    def of(side: str, column: str) -> Column:
        kind = EXACT if column in ("ww", "pp", "wp") else "long"
        return F.coalesce(F.sum(F.when(F.col("variant") == side, F.col(column))), F.lit(0)).cast(kind).alias(f"{side}_{column}")

    row = sides.groupBy(*by).agg(*[of(side, c) for side in (CONTROL, TREATMENT) for c in fields])
    for side in (CONTROL, TREATMENT):
        for name, sql in _side(side).items():
            row = row.withColumn(name, F.expr(sql))
    row = row.withColumn("lift", F.expr(f"{TREATMENT}_rate - {CONTROL}_rate"))
    row = row.withColumn("error", F.expr(f"nullif(sqrt({TREATMENT}_variance + {CONTROL}_variance), 0D)"))
    shown = [
        column
        for side in (CONTROL, TREATMENT)
        for column in (
            F.col(f"{side}_users"),
            F.col(f"{side}_whole").alias(f"{side}_{whole}"),
            F.col(f"{side}_part").alias(f"{side}_{part}"),
            percent(f"{side}_part", f"{side}_whole").alias(f"{side}_{rate}"),
        )
    ]
    return row.select(
        *by,
        *shown,
        rounded("100D * lift", 4).alias("lift_points"),
        rounded("100D * error", 4).alias("standard_error_points"),
        rounded(f"100D * (lift - {Z_TWO_SIDED}D * error)", 4).alias("low_points"),
        rounded(f"100D * (lift + {Z_TWO_SIDED}D * error)", 4).alias("high_points"),
        rounded("lift / error", 4).alias("z_value"),
        rounded(f"error * error / nullif({TREATMENT}_naive + {CONTROL}_naive, 0D)", 4).alias("design_effect"),
        rounded(f"100D * ({Z_TWO_SIDED}D + {Z_POWER}D) * error", 4).alias("detectable_points"),
    ).withColumn("significant_at_5pct", F.abs("z_value") > F.lit(Z_TWO_SIDED))


def _attempts_per_user(tx: DataFrame) -> DataFrame:
    known = tx.filter(F.col("user_id").isNotNull())
    return known.groupBy("user_id").agg(F.count(F.lit(1)).alias("whole"), flags.count_where(flags.succeeded()).alias("part"))


def experiment_readout(tx: DataFrame, salt: str = SALT, treated_pct: int = 50) -> DataFrame:
    """One row: the success rate of both variants, compared with users as units.

    Attempts are summed map-side to a row per user, then to a row per variant, which is
    computed from the user id in place. Attempts without a user are left out.
    """
    return ratio_readout(_attempts_per_user(tx), ("txns", "successes", "psr"), salt, treated_pct)


def retry_readout(
    tx: DataFrame, window_s: float = 900, tol: float | None = 0.10, salt: str = SALT, treated_pct: int = 50, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: the share of retried failures whose retry succeeds, in both variants.

    ``tx`` are attempts or their chain; see :func:`railpulse.operators.retries.retry_attempts`.
    """
    retried = retry_attempts(tx, window_s, tol, hot_rows).filter(F.col("user_id").isNotNull())
    good = flags.count_where(F.col("next_final_status") == D.SUCCESS)
    per_user = retried.groupBy("user_id").agg(F.count(F.lit(1)).alias("whole"), good.alias("part"))
    return ratio_readout(per_user, ("retried", "successful_retries", "retry_success"), salt, treated_pct)


def duplicate_readout(
    tx: DataFrame, window_s: float = 180, salt: str = SALT, treated_pct: int = 50, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: the share of completed payments that repeat a completed one, in both variants."""
    chain = completed_chain(tx, hot_rows=hot_rows).filter(F.col("user_id").isNotNull())
    per_user = chain.groupBy("user_id").agg(F.count(F.lit(1)).alias("whole"), repeats_completed(window_s).alias("part"))
    return ratio_readout(per_user, ("completed", "duplicates", "duplicate_rate"), salt, treated_pct)


def aa_readouts(tx: DataFrame, salts: list[str] = AA_SALTS, treated_pct: int = 50) -> DataFrame:
    """The readout under each salt, a row per salt: what an experiment without a treatment shows.

    About one salt in twenty should look significant; more mean that the statistic
    takes for independent what is not. Users are dealt anew under every salt from their
    totals, so the attempts are read once.
    """
    dealt = _attempts_per_user(tx).withColumn("salt", F.explode(F.array(*[F.lit(s) for s in salts])))
    rows = ratio_readout(dealt, ("txns", "successes", "psr"), F.col("salt"), treated_pct, by=("salt",))
    return rows.select("salt", "control_users", "treatment_users", "lift_points", "z_value", "design_effect", "significant_at_5pct")
