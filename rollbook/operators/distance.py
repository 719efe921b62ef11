"""Distances of schools and homes, and travel costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import geo, recode
from rollbook.operators.reshape import histogram


def distance_to_point(
    schools: DataFrame, origin: tuple[float, float] = (K.ORIGIN_LNG, K.ORIGIN_LAT),
    digits: int | None = 2,
) -> DataFrame:
    """Kilometres of each row's ``lng``/``lat`` from a fixed (lng, lat) point."""
    km = geo.origin_km(F.col("lng"), F.col("lat"), origin)
    return schools.withColumn("distance", km if digits is None else F.bround(km, digits))


def travel_cost(schools: DataFrame, digits: int | None = 2, **cost: float) -> DataFrame:
    """Add the transport cost of a visit; NULL without a distance."""
    euros = geo.travel_euros(F.col("distance"), **cost)
    return schools.withColumn("euros", euros if digits is None else F.bround(euros, digits))


def projected_total(costs: DataFrame, n_schools: int = K.EXPECTED_SCHOOLS) -> DataFrame:
    """Cost of visiting ``n_schools`` at the mean cost of those located."""
    return costs.agg((F.avg("euros") * n_schools).alias("total_euros"))


def without_coordinates(schools: DataFrame, name: str = "SCHOOL_NAME") -> DataFrame:
    """Names of schools that have no position, in order."""
    return schools.filter(F.col("lat").isNull()).select(name).orderBy(name)


def cost_table(costs: DataFrame) -> DataFrame:
    """The cost columns under upper-case names."""
    return recode.upper_columns(
        costs.select("SCHOOL_NAME", "distance", "euros", "n_students", "district_number")
    )


def distance_to_own(
    students: DataFrame, schools: DataFrame, school: str = "SCHOOL_NAME",
    max_km: float | None = K.MAX_HOME_KM,
) -> DataFrame:
    """Kilometres from a student's home to the student's own school."""
    places = schools.select(
        school, F.col("lng").alias("school_lng"), F.col("lat").alias("school_lat")
    )
    joined = students.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).join(
        places, school, "inner"
    )
    km = geo.sphere_km(F.col("lng"), F.col("lat"), F.col("school_lng"), F.col("school_lat"))
    result = joined.withColumn("distance_to_school", km)
    return result if max_km is None else result.filter(F.col("distance_to_school") < max_km)


def mean_distance(distances: DataFrame, school: str = "SCHOOL_NAME") -> DataFrame:
    """Mean distance per school, the longest first."""
    return distances.groupBy(school).agg(
        F.avg("distance_to_school").alias("avg_km"), F.count(F.lit(1)).alias("n_students")
    ).orderBy(F.desc("avg_km"), school)


def distance_distribution(
    distances: DataFrame, width_km: float = 1.0, by: str = "district"
) -> DataFrame:
    """Histogram of distances to school per district."""
    known = distances.filter(F.col(by).isNotNull())
    return histogram(known, "distance_to_school", 0.0, width_km, [by])
