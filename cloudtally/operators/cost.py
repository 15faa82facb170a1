"""Which estate a charge belongs to, and what a thousand requests cost there."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.money import per_thousand, share
from cloudtally.functions.tags import tag
from cloudtally.operators.focus import AWS, GOOGLE, MICROSOFT
from cloudtally.schemas import MONEY

# Services whose untagged charges are taken to be the platform's.
ESTATE_SERVICES = (
    "Amazon Elastic Container Service",
    "Amazon Virtual Private Cloud",
    "Elastic Load Balancing",
)

HUB = "hub"


@dataclass(frozen=True)
class Platform:
    """What identifies this platform's charges among everything billed."""

    host_project: str
    project_tag: str
    estate_services: Sequence[str] = ESTATE_SERVICES


def charges_since(focus: DataFrame, start: date | None = None) -> DataFrame:
    """Charges from a day on, with the two tags that attribution reads."""
    rows = focus if start is None else focus.filter(F.col("ChargePeriodStart") >= F.lit(start).cast("timestamp"))
    return rows.select(
        F.to_date("ChargePeriodStart").alias("day"),
        "ProviderName",
        "SubAccountId",
        "ServiceName",
        "BilledCost",
        tag(F.col("Tags"), "project").alias("project_tag"),
        tag(F.col("Tags"), "estate").alias("estate_tag"),
    )


def estate_of(platform: Platform) -> Column:
    """The estate a charge goes to, NULL when it is outside the platform."""
    provider, project = F.col("ProviderName"), F.col("project_tag")
    ours = project == platform.project_tag
    inferred = project.isNull() & F.col("ServiceName").isin(*platform.estate_services)
    in_host = F.col("SubAccountId") == platform.host_project
    return (
        F.when((provider == GOOGLE) & in_host, F.coalesce("estate_tag", F.lit(HUB)))
        .when((provider == AWS) & (ours | inferred), F.lit("aws"))
        .when((provider == MICROSOFT) & ours, F.lit("azure"))
    )


def basis_of() -> Column:
    """How the estate was found. Decided apart from the estate itself."""
    provider = F.col("ProviderName")
    return (
        F.when((provider == AWS) & F.col("project_tag").isNull(), "inferred")
        .when((provider == GOOGLE) & F.col("estate_tag").isNull(), "project")
        .otherwise("tagged")
    )


def attribute(charges: DataFrame, platform: Platform) -> DataFrame:
    return charges.withColumns({"estate": estate_of(platform), "basis": basis_of()})


def daily_cost(attributed: DataFrame) -> DataFrame:
    """Cost per day and estate, split by how it was attributed; outside charges dropped.

    They are dropped after the sums, by a count no filter can be moved below. A
    filter on the estate would be pushed under the tag look-up, which would then
    be worked out again, several times, for every charge.
    """
    def part(basis: str) -> Column:
        return F.sum(F.when(F.col("basis") == basis, F.col("BilledCost")).otherwise(0)).alias(f"{basis}_cost")

    sums = attributed.groupBy("day", "estate").agg(
        F.sum("BilledCost").alias("cost"), part("tagged"), part("inferred"), part("project"), _inside()
    )
    return sums.filter(F.col("_inside") > 0).drop("_inside")


def _inside() -> Column:
    """Charges of a group that belong to the platform."""
    return F.count("estate").alias("_inside")


def estate_requests(load_runs: DataFrame) -> DataFrame:
    """Requests that succeeded, per day and estate."""
    return load_runs.groupBy(F.to_date("run_at").alias("day"), F.col("cloud").alias("estate")).agg(
        F.sum("ok").alias("requests")
    )


def platform_requests(load_runs: DataFrame) -> DataFrame:
    """Requests served anywhere, per day: a second level on the per-estate counts."""
    return estate_requests(load_runs).groupBy("day").agg(F.sum("requests").alias("requests"))


def denominators(load_runs: DataFrame) -> DataFrame:
    """What each estate's cost is divided by, in one table.

    Per-estate counts plus a hub row per day holding all estates' total, made by
    grouping sets over the already aggregated counts, so cost needs one join.
    """
    per_estate = estate_requests(load_runs)
    sets = per_estate.groupingSets(
        [[F.col("day"), F.col("estate")], [F.col("day")]], F.col("day"), F.col("estate")
    ).agg(F.sum("requests").alias("requests"), F.grouping("estate").alias("whole_day"))
    return sets.filter((F.col("whole_day") == 1) | (F.col("estate") != HUB)).select(
        "day",
        F.when(F.col("whole_day") == 1, F.lit(HUB)).otherwise(F.col("estate")).alias("estate"),
        "requests",
    )


def unit_cost(
    focus: DataFrame, load_runs: DataFrame, start: date, platform: Platform, places: int | None = 4
) -> DataFrame:
    """Cost per estate and day, and per thousand requests.

    Cost drives the join: requests never create a row, and none before
    ``start`` are read. Only the final figures are rounded, to ``places`` (not at
    all without), and the ratio is taken from the unrounded cost.
    """
    cost = daily_cost(attribute(charges_since(focus, start), platform))
    runs = load_runs.filter(F.col("run_at") >= F.lit(start).cast("timestamp"))
    both = cost.join(denominators(runs), ["day", "estate"], "left")
    figures = ("cost", "tagged_cost", "inferred_cost", "project_cost")
    money = [F.col(c) if places is None else F.round(c, places).alias(c) for c in figures]
    return both.select(
        "day",
        "estate",
        *money,
        "requests",
        per_thousand(F.col("cost"), F.col("requests")).alias("cost_per_1000_requests"),
    )


def outside_charges(focus: DataFrame, start: date, platform: Platform) -> DataFrame:
    """What attribution left out, as an unallocated report."""
    outside = F.col("estate").isNull()
    return (
        attribute(charges_since(focus, start), platform)
        .groupBy("ProviderName", "ServiceName", F.col("project_tag").alias("project"))
        .agg(F.sum(F.when(outside, F.col("BilledCost"))).alias("cost"), F.count_if(outside).alias("charges"))
        .filter(F.col("charges") > 0)
    )


def report_start(as_of: date, days: int = 7, start: date | None = None) -> date:
    """The first day a report over the last days needs: bills and requests are read from it on."""
    since = as_of - timedelta(days=days)
    return since if start is None else max(since, start)


def recent_unit_cost(unit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """The last days of a unit cost that was made from ``report_start`` on."""
    return unit.filter(F.col("day") >= F.date_sub(F.lit(as_of), days)).orderBy("day", "estate")


def recent_spend(focus: DataFrame, as_of: date, days: int = 7, above: float = 0.01) -> DataFrame:
    """Days by provider, service and project tag; untagged spend stays a group of its own."""
    since = F.date_sub(F.lit(as_of), days).cast("timestamp")
    return (
        focus.filter(F.col("ChargePeriodStart") >= since)
        .groupBy(
            F.to_date("ChargePeriodStart").alias("day"),
            "ProviderName",
            "ServiceName",
            tag(F.col("Tags"), "project").alias("project"),
        )
        .agg(F.round(F.sum("BilledCost"), 4).alias("cost"))
        .filter(F.col("cost") > F.lit(above).cast("decimal(38,9)"))
        .orderBy("day", F.desc("cost"))
    )


def spend_to_date(focus: DataFrame, month: date, above: float = 0.001) -> DataFrame:
    """One billing month so far, by provider, project tag, estate tag and service."""
    return (
        focus.filter(F.col("BillingPeriodStart") == F.trunc(F.lit(month), "MM").cast("timestamp"))
        .groupBy(
            "ProviderName",
            tag(F.col("Tags"), "project").alias("project"),
            tag(F.col("Tags"), "estate").alias("estate"),
            "ServiceName",
        )
        .agg(F.round(F.sum("BilledCost"), 4).alias("billed"))
        .filter(F.col("billed") > F.lit(above).cast("decimal(38,9)"))
    )


def tag_coverage(daily: DataFrame) -> DataFrame:
    """Share of each estate's cost that carries its own tag."""
    return (
        daily.groupBy("estate")
        .agg(F.sum("cost").alias("cost"), F.sum("tagged_cost").alias("tagged_cost"))
        .withColumn("coverage", share(F.col("tagged_cost"), F.col("cost")))
    )


def full_day_summary(unit: DataFrame, first: date, last: date) -> DataFrame:
    """Over complete days: mean daily cost, range of unit cost, a 30-day projection.

    The mean is over calendar days: a day without a charge costs nothing.
    ``days`` counts the days that had one.
    """
    mean = F.sum("cost") / F.lit((last - first).days + 1)
    unit_price = F.col("cost_per_1000_requests")
    return (
        unit.filter(F.col("day").between(F.lit(first), F.lit(last)))
        .groupBy("estate")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.round(mean, 4).alias("cost_per_day"),
            F.min(unit_price).alias("lowest_unit_cost"),
            F.max(unit_price).alias("highest_unit_cost"),
            F.round(mean * 30, 2).alias("thirty_days"),
        )
    )


def provider_totals(focus: DataFrame) -> DataFrame:
    """Spend per provider, with the grand total as the row whose provider is ``all``.

    The roll-up runs over the per-provider sums; over the charges themselves it
    would copy every row once per level.
    """
    return (
        focus.groupBy("ProviderName")
        .agg(F.sum("BilledCost").alias("billed"))
        .rollup("ProviderName")
        .agg(F.sum("billed").cast(MONEY).alias("billed"), F.grouping("ProviderName").alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, F.lit("all")).otherwise(F.col("ProviderName")).alias("ProviderName"),
            "billed",
        )
    )


def estate_makeup(attributed: DataFrame) -> DataFrame:
    """What each estate's spend is made of, by service, with its share.

    The window runs over the services of an estate, after aggregation.
    """
    by_service = (
        attributed.groupBy("estate", "ServiceName")
        .agg(F.sum("BilledCost").alias("cost"), _inside())
        .filter(F.col("_inside") > 0)
        .drop("_inside")
    )
    whole = F.sum("cost").over(Window.partitionBy("estate"))
    return by_service.withColumn("share", share(F.col("cost"), whole))
