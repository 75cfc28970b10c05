"""Column functions on scores and money."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import ratio

# The interval quantile and the token unit of a price.
Z_95 = 1.96
MTOK = 1_000_000.0
# Two-sided 97.5 % Student-t quantiles by degrees of freedom.
T_975 = (
    (1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365),
    (8, 2.306), (9, 2.262), (10, 2.228), (12, 2.179), (15, 2.131), (20, 2.086), (25, 2.060),
    (30, 2.042),
)


def decision(score: Column, threshold: Column, error: Column | None = None) -> Column:
    out = F.when(score >= threshold, "flag").when(score < threshold, "pass")
    if error is not None:
        out = F.when(error.isNotNull(), "error").when(score >= threshold, "flag").when(score < threshold, "pass")
    return out.otherwise("not_run")


def cost_usd(input_tokens: Column, output_tokens: Column, in_rate: Column, out_rate: Column, verified: Column) -> Column:
    """Cost of one request, NULL unless usage, a verified row and both rates exist."""
    return F.when(
        verified & input_tokens.isNotNull() & in_rate.isNotNull() & out_rate.isNotNull(),
        (input_tokens.cast("double") * in_rate + output_tokens.cast("double") * out_rate) / F.lit(MTOK),
    )


def fx(usd: Column, rate: float) -> Column:
    return usd * F.lit(float(rate))


def wilson(successes: Column, total: Column, z: float = Z_95) -> Column:
    """STRUCT<point, lower, upper>, all NULL over nothing."""
    n = total.cast("double")
    p = ratio(successes, total)
    z2 = F.lit(z * z)
    scale = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / scale
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / scale
    some = total > 0
    return F.struct(
        F.when(some, p).alias("point"),
        F.when(some, F.greatest(F.lit(0.0), centre - margin)).alias("lower"),
        F.when(some, F.least(F.lit(1.0), centre + margin)).alias("upper"),
    )


def t_critical(df: Column) -> Column:
    """The table value, the nearest smaller one between entries, 1.96 past the end."""
    out = F.lit(None).cast("double")
    for low, value in T_975:
        out = F.when(df >= low, F.lit(value)).otherwise(out)
    return F.when(df > T_975[-1][0], F.lit(Z_95)).when(df > 0, out)


def project_tokens(chars: Column, chars_per_token: float, overhead: int, requests: Column) -> Column:
    return (F.bround(chars.cast("double") / F.lit(float(chars_per_token)), 0) + overhead * requests).cast("bigint")


def backoff_delay(attempt: Column, retry_after: Column, jitter_draw: Column, initial=0.5, cap=5.0, jitter=0.25) -> Column:
    """The server's own delay when given, else capped doubling less a jitter share."""
    grown = F.least(F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))
    return F.when(retry_after.isNotNull(), F.greatest(F.lit(0.0), retry_after)).otherwise(
        grown * (F.lit(1.0) - F.lit(float(jitter)) * jitter_draw)
    )


def state_char_budget(longest_question: Column, tokens: int = 32_000, chars_per_token: float = 2.5) -> Column:
    return F.greatest(F.lit(1_000), F.lit(int(tokens * chars_per_token)) - longest_question)


def parse_utc(stamp: Column) -> Column:
    """A stamp ending in Z as an instant, whatever the session's zone; else NULL."""
    zulu = F.endswith(stamp, F.lit("Z"))
    return F.when(zulu, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def size_label(size: Column) -> Column:
    return F.coalesce(size.cast("string"), F.lit("full"))


def parse_size(label: Column) -> Column:
    return F.when(label != "full", label.cast("int"))


def format_value(value: Column, digits: int = 3) -> Column:
    """Fixed digits for display; an em dash where there is no value."""
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.format_string(f"%.{digits}f", value))


def verdict(lower: Column, upper: Column, ran: Column) -> Column:
    return (
        F.when(~ran, "not_run")
        .when(lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper), "not_computable")
        .when(lower > 0, "wins")
        .when(upper < 0, "loses")
        .otherwise("no_difference")
    )
