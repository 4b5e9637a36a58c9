"""Least-squares statistics as column expressions."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_t_two_sided(df: DataFrame, out: str, t: Column, nu: Column) -> DataFrame:
    """Add P(|T| > t) for Student's t with integer ``nu`` >= 1; NULL where ``t`` is.

    The finite cosine series of Abramowitz & Stegun 26.7.3-4.  Built in steps, so the loop over terms touches plain
    columns only.
    """
    staged = df.withColumns({"_t": t, "_nu": nu, "_odd": nu % 2}).withColumns({
        "_cos2": F.col("_nu") / (F.col("_nu") + F.col("_t") * F.col("_t")),
        "_sine": F.col("_t") / F.sqrt(F.col("_nu") + F.col("_t") * F.col("_t")),
        "_terms": F.shiftright(F.col("_nu") - F.col("_odd"), 1).cast("int"),
    })
    first = F.when(F.col("_odd") == 1, F.sqrt("_cos2")).otherwise(F.lit(1.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.col("_terms")),
        F.struct(F.lit(0.0).alias("total"), first.alias("term")),
        lambda acc, j: F.struct(
            (acc["total"] + acc["term"]).alias("total"),
            (acc["term"] * F.col("_cos2") * (2 * j - 1 + F.col("_odd")) / (2 * j + F.col("_odd"))).alias("term"),
        ),
        lambda acc: acc["total"],
    )
    summed = staged.withColumn(
        "_series", F.when(F.col("_t").isNotNull() & (F.col("_terms") >= 1), series).otherwise(F.lit(0.0)))
    inside = F.when(
        F.col("_odd") == 1,
        (F.atan(F.col("_t") / F.sqrt("_nu")) + F.col("_sine") * F.col("_series")) * (2 / math.pi),
    ).otherwise(F.col("_sine") * F.col("_series"))
    tail = F.when(F.col("_t").isNotNull(), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))
    return summed.withColumn(out, tail).drop("_t", "_nu", "_odd", "_cos2", "_sine", "_terms", "_series")


def with_fit(df: DataFrame, min_n: int) -> DataFrame:
    """All statistics of a line fit from the columns ``_n, _x_mean, _y_mean, _sxx, _syy, _sxy`` (centred moments).

    NULL where a fit does not exist.  Slope and intercept need ``min_n`` points and two distinct x; the error
    statistics need three points; a perfect fit has significance 0, and a constant series (slope 0, error 0) none.
    """
    n, x_mean, sxx, sxy = F.col("_n"), F.col("_x_mean"), F.col("_sxx"), F.col("_sxy")
    slope, mse, error = F.col("slope"), F.col("mse"), F.col("slope_stderr")
    fits = (n >= min_n) & (n >= 2) & (sxx > 0)
    staged = (
        df
        .withColumn("slope", F.when(fits, sxy / sxx))
        .withColumns({
            "intercept": F.col("_y_mean") - slope * x_mean,
            "sse": F.when(slope.isNotNull(), F.greatest(F.lit(0.0), F.col("_syy") - slope * sxy)),
        })
        .withColumn("mse", F.when(n >= 3, F.col("sse") / (n - 2)))
        .withColumns({
            "slope_stderr": F.sqrt(mse / sxx),
            "intercept_stderr": F.sqrt(mse * (F.lit(1.0) / n + x_mean * x_mean / sxx)),
        })
    )
    tested = with_t_two_sided(staged, "significance", F.when(error > 0, F.abs(slope) / error), n - 2)
    return tested.withColumn(
        "significance", F.when((error == 0) & (slope != 0), F.lit(0.0)).otherwise(F.col("significance")))


def line_fit(y: str, x: str) -> list[Column]:
    """Aggregates: the least-squares line of y on x, with its sums of squares.

    Spark's ``regr_*`` aggregate partially, so no group's rows are ever gathered.
    """
    yd, xd = F.col(y).cast("double"), F.col(x).cast("double")
    return [
        F.regr_count(yd, xd).alias("n"),
        F.regr_avgx(yd, xd).alias("x_mean"),
        F.regr_avgy(yd, xd).alias("y_mean"),
        F.regr_sxx(yd, xd).alias("sxx"),
        F.regr_syy(yd, xd).alias("syy"),
        F.regr_sxy(yd, xd).alias("sxy"),
    ]


def sums_of_squares() -> dict[str, Column]:
    """Slope m, intercept c, total, regression and residual sums of squares, over ``line_fit`` columns."""
    sxx, syy, sxy = F.col("sxx"), F.col("syy"), F.col("sxy")
    m = F.when(sxx > 0, sxy / sxx)
    explained = F.when(sxx > 0, sxy * sxy / sxx)
    return {
        "m": m,
        "c": F.col("y_mean") - m * F.col("x_mean"),
        "ssto": syy,
        "ssr": explained,
        "sse": F.greatest(F.lit(0.0), syy - explained) * F.when(sxx > 0, 1),
    }


def diagnostics() -> dict[str, Column]:
    """R squared, residual variance and the standard errors of both coefficients, over ``line_fit`` columns.

    The intercept's error is given by two equivalent formulas.
    """
    n, x_mean, sxx, syy = F.col("n"), F.col("x_mean"), F.col("sxx"), F.col("syy")
    squares = sums_of_squares()
    svar = F.when((n > 2) & (sxx > 0), squares["sse"] / (n - 2))
    sum_x2 = sxx + n * x_mean * x_mean
    return {
        "r2": F.when(syy > 0, squares["ssr"] / syy),
        "residual_variance": svar,
        "slope_stderr": F.sqrt(svar / sxx),
        "intercept_stderr": F.sqrt(svar / n + x_mean * x_mean * svar / sxx),
        "intercept_stderr_alt": F.sqrt(svar * sum_x2 / (n * sxx)),
    }
