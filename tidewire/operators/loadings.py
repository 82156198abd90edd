"""How a ticker's daily sentiment goes with the factors of the same day: least squares per ticker.

Days and factors meet in one join, and a ticker is one row of means and covariances, which combine on the map
side; the three equations that are left are solved by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTORS = ["mkt_rf", "smb", "hml"]
LEAST_DAYS = 5
SINGULAR = 1e-12    # of the product of the variances; a smaller determinant has no solution


def _determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def factor_loadings(daily: DataFrame, factors: DataFrame, score: str = "Final_Sentiment") -> DataFrame:
    """(ticker, num_days, alpha, beta_mkt_rf, beta_smb, beta_hml, r_squared).

    Only days that both tables have count. With fewer than ``LEAST_DAYS`` of them, or where the factors depend
    on each other, the estimates are null; a score that never changes has no ``r_squared``.
    """
    days = daily.select("ticker", "date", F.col(score).cast("double").alias("_y"))
    joined = days.join(factors.select("date", *FACTORS), "date").dropna("any", subset=["_y", *FACTORS])
    pairs = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i:]]
    sums = joined.groupBy("ticker").agg(
        F.count("*").alias("num_days"), F.avg("_y").alias("mean_y"), F.var_pop("_y").alias("var_y"),
        *[F.avg(f).alias(f"mean_{f}") for f in FACTORS],
        *[F.covar_pop(f, "_y").alias(f"{f}_y") for f in FACTORS],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs],
    )

    def covariance(a: str, b: str) -> Column:
        return F.col(f"{a}_{b}" if (a, b) in pairs else f"{b}_{a}")

    matrix = [[covariance(a, b) for b in FACTORS] for a in FACTORS]
    whole = _determinant(matrix)
    spread = matrix[0][0] * matrix[1][1] * matrix[2][2]
    solvable = (F.col("num_days") >= LEAST_DAYS) & (whole > SINGULAR * spread)
    solved = sums.withColumn("_whole", F.when(solvable, whole))
    betas = {}
    for k, name in enumerate(FACTORS):
        turned = [[F.col(f"{FACTORS[r]}_y") if c == k else matrix[r][c] for c in range(3)] for r in range(3)]
        betas[f"beta_{name}"] = _determinant(turned) / F.col("_whole")
    solved = solved.withColumns(betas)
    alpha, explained = F.col("mean_y"), F.lit(0.0)
    for name in FACTORS:
        alpha = alpha - F.col(f"beta_{name}") * F.col(f"mean_{name}")
        explained = explained + F.col(f"beta_{name}") * F.col(f"{name}_y")
    share = F.when(F.col("var_y") > 0, explained / F.col("var_y"))
    return solved.select("ticker", "num_days", alpha.alias("alpha"), *betas, share.alias("r_squared"))
