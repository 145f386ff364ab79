"""Subscription plans: limits, effective plan, pages granted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import cases

#: Pages a file, MB a file, pages a period, free preview pages, by plan.
LIMITS = {"free": (3, 25, 20, 3), "starter": (50, 50, 100, 0), "pro": (300, 100, 500, 0), "power": (3000, 250, 3000, 0)}
#: Dollars a month and a year.
PRICES = {"free": (0.0, 0.0), "starter": (12.0, 120.0), "pro": (48.0, 480.0), "power": (240.0, 2400.0)}
ACTIVE = ["active", "trialing"]
#: The kind of model a plan translates with; any other is "basic".
MODELS = {"starter": "advanced", "pro": "advanced", "power": "advanced"}


def plan_table(spark: SparkSession) -> DataFrame:
    """One row a plan."""
    rows = [(k, *v) for k, v in LIMITS.items()]
    return spark.createDataFrame(rows, "plan string, max_pages_per_file int, max_file_size_mb int, period_quota int, preview_pages int")


def effective_plan(plan: Column, status: Column) -> Column:
    """Unknown plans are free; a paid plan counts only while its subscription is active or on trial."""
    p, s = F.lower(F.trim(plan)), F.lower(F.trim(status))
    return F.when(p.isin([k for k in LIMITS if k != "free"]) & s.isin(ACTIVE), p).otherwise("free")


def limit(plan: Column, which: int) -> Column:
    return cases(plan, {k: v[which] for k, v in LIMITS.items()})


def translatable_pages(plan: Column, total: Column) -> Column:
    """Pages of a file that the plan translates: the preview of a free plan, else up to the file limit."""
    most = F.when(plan == "free", limit(plan, 3)).otherwise(limit(plan, 0))
    return F.when(total <= 0, 0).otherwise(F.least(total, most))


def authorised(plan: Column, total: Column, remaining: Column) -> tuple[Column, Column]:
    """(pages granted or null, reason or null): 402 without quota, 413 beyond the file limit.

    A free plan gets what is left of its preview; a paid plan gets the whole file or nothing.
    """
    preview = F.least(translatable_pages(plan, total), remaining)
    free = plan == "free"
    reason = F.when((remaining <= 0) | (free & (preview <= 0)), "402").when(~free & (total > limit(plan, 0)), "413").when(~free & (total > remaining), "402")
    return F.when(reason.isNull(), F.when(free, preview).otherwise(total)), reason
