"""Centiles against a reference standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.stats import normal_cdf, normal_quantile, skew_t_centile

# Day ranges of the two standards, and the log-normal one for very preterm births.
VERY_PRETERM_DAYS = (168, 230)
TERM_DAYS = (231, 300)
LOG_MEAN = (-7.00303, 1.325911, 0.0571937)  # intercept, sqrt(weeks), male
LOG_VARIANCE = 0.0373218


def birth_weight_centiles(births: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Adds ``centile`` and ``zscore`` to (weight_kg, gest_days, sex); null outside both ranges.

    Coefficients (sex, gest_days, mu, sigma, nu, tau) are looked up by sex and day.
    """
    w, days = F.col("weight_kg"), F.col("gest_days")
    ok = (w > 0) & days.isNotNull() & F.col("sex").isin("male", "female")
    mean = LOG_MEAN[0] + LOG_MEAN[1] * F.sqrt(days / 7.0) + LOG_MEAN[2] * (F.col("sex") == "male").cast("double")
    early = ok & (days >= VERY_PRETERM_DAYS[0]) & (days < TERM_DAYS[0])
    late = ok & (days >= TERM_DAYS[0]) & (days <= TERM_DAYS[1])
    joined = births.join(coefficients, ["sex", "gest_days"], "left")
    z = F.when(early, (F.ln(w) - mean) / F.sqrt(F.lit(LOG_VARIANCE)))
    centile = F.when(early, normal_cdf(z)).when(
        late, skew_t_centile(w.cast("double"), F.col("mu"), F.col("sigma"), F.col("nu"), F.col("tau"))
    )
    return joined.withColumn("centile", centile).withColumn("zscore", normal_quantile("centile")).select(
        *births.columns, "centile", F.when(F.col("centile").isNotNull(), F.col("zscore")).alias("zscore")
    )
