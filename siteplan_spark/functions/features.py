"""Area features from published survey counts, null-strict at every grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import binned_mean, log_density, null_if_jam, share

# Survey variable codes behind each feature, and the bin midpoints.
POPULATION = "B01003_001E"
HOUSEHOLDS = "B25003_001E"
MEDIAN_INCOME = "B19013_001E"
INCOME_TOTAL = "B19001_001E"
INCOME_HIGH = ("B19001_014E", "B19001_015E", "B19001_016E", "B19001_017E")
INCOME_LOW = ("B19001_002E", "B19001_003E", "B19001_004E", "B19001_005E", "B19001_006E",
              "B19001_007E")
OWNER_OCCUPIED = "B25003_002E"
STRUCTURES_TOTAL = "B25024_001E"
SINGLE_FAMILY = ("B25024_002E", "B25024_003E")
MULTIFAMILY = ("B25024_004E", "B25024_005E", "B25024_006E", "B25024_007E", "B25024_008E",
               "B25024_009E")
VEHICLES_TOTAL = "B25044_001E"
NO_VEHICLE = ("B25044_003E", "B25044_010E")
VEHICLE_BINS = ("B25044_003E", "B25044_004E", "B25044_005E", "B25044_006E", "B25044_007E",
                "B25044_008E", "B25044_010E", "B25044_011E", "B25044_012E", "B25044_013E",
                "B25044_014E", "B25044_015E")
VEHICLE_MIDPOINTS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
WORKERS_TOTAL = "B08301_001E"
DROVE_ALONE = "B08301_003E"
PUBLIC_TRANSIT = "B08301_010E"
WORKED_FROM_HOME = "B08301_021E"
COMMUTE_TOTAL = "B08303_001E"
COMMUTE_BINS = tuple(f"B08303_{i:03d}E" for i in range(2, 14))
COMMUTE_MIDPOINTS = (2.5, 7.0, 12.0, 17.0, 22.0, 27.0, 32.0, 37.0, 42.0, 52.0, 74.5, 100.0)
EDUCATION_TOTAL = "B15003_001E"
BACHELORS_PLUS = ("B15003_022E", "B15003_023E", "B15003_024E", "B15003_025E")


def feature_columns() -> dict[str, Column]:
    """Feature name to Column, over numeric survey columns plus ``land_area_km2``."""
    return {
        "log_population_density_km2": log_density(POPULATION, "land_area_km2"),
        "median_household_income_k": F.col(MEDIAN_INCOME) / 1000.0,
        "income_share_over_100k": share(INCOME_HIGH, INCOME_TOTAL),
        "income_share_under_35k": share(INCOME_LOW, INCOME_TOTAL),
        "owner_occupied_share": share([OWNER_OCCUPIED], HOUSEHOLDS),
        "single_family_share": share(SINGLE_FAMILY, STRUCTURES_TOTAL),
        "multifamily_share": share(MULTIFAMILY, STRUCTURES_TOTAL),
        "zero_vehicle_household_share": share(NO_VEHICLE, VEHICLES_TOTAL),
        "vehicles_per_household": binned_mean(VEHICLE_BINS, VEHICLE_MIDPOINTS, VEHICLES_TOTAL),
        "drove_alone_share": share([DROVE_ALONE], WORKERS_TOTAL),
        "public_transit_share": share([PUBLIC_TRANSIT], WORKERS_TOTAL),
        "worked_from_home_share": share([WORKED_FROM_HOME], WORKERS_TOTAL),
        "mean_commute_minutes": binned_mean(COMMUTE_BINS, COMMUTE_MIDPOINTS, COMMUTE_TOTAL),
        "bachelors_plus_share": share(BACHELORS_PLUS, EDUCATION_TOTAL),
    }


def survey_variables() -> list[str]:
    single = (POPULATION, HOUSEHOLDS, MEDIAN_INCOME, INCOME_TOTAL, OWNER_OCCUPIED,
              STRUCTURES_TOTAL, VEHICLES_TOTAL, WORKERS_TOTAL, DROVE_ALONE, PUBLIC_TRANSIT,
              WORKED_FROM_HOME, COMMUTE_TOTAL, EDUCATION_TOTAL)
    grouped = INCOME_HIGH + INCOME_LOW + SINGLE_FAMILY + MULTIFAMILY + NO_VEHICLE \
        + VEHICLE_BINS + COMMUTE_BINS + BACHELORS_PLUS
    return sorted(set(single) | set(grouped))


def compute_features(df: DataFrame, keep: Sequence[str] = ("geoid",)) -> DataFrame:
    """Staged text rows to exposure columns plus the fourteen features, no row dropped."""
    present = set(df.columns)
    numeric = df.select(
        *keep,
        *[(null_if_jam(v) if v in present else F.lit(None).cast("double")).alias(v)
          for v in survey_variables()],
        F.col("land_area_km2").cast("double").alias("land_area_km2"))
    return numeric.select(
        *keep,
        F.coalesce(POPULATION, F.lit(0.0)).alias("population"),
        F.coalesce(HOUSEHOLDS, F.lit(0.0)).alias("households"),
        *[c.alias(name) for name, c in feature_columns().items()])
