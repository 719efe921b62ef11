"""Census harmonisation and linkage of students to people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates, geo, keys, recode
from rollbook.operators import joins, names
from rollbook.operators.dedupe import keep_first

CENSUS_COLUMNS = ("permid", "dob", "gender", "name", "house_number", "lng", "lat", "geo")
COORDINATE_ALIASES = {"lng": ("longitude", "x", "lon"), "lat": ("latitude", "y")}


def member_census(members: DataFrame, households: DataFrame, place: str) -> DataFrame:
    """Census kept as members and households, each household with its position."""
    located = households.select(
        F.col("HOUSEHOLD_HEAD_AGREG_NUM").alias("house_number"),
        F.col("HOUSEHOLD_HEAD_GPS_LNG").alias("lng"),
        F.col("HOUSEHOLD_HEAD_GPS_LAT").alias("lat"),
    )
    people = members.select(
        F.col("PERM_ID_MEMBER").alias("permid"),
        dates.iso_prefix_date(F.col("BIRTH_MEMBER")).alias("dob"),
        recode.recode(F.col("MEMBER_GENDER"), K.MEMBER_GENDER).alias("gender"),
        F.col("MEMBER_NAME").alias("name"),
        F.col("HOUSEHOLD_NUMBER").alias("house_number"),
    )
    joined = people.join(located, "house_number", "left").withColumn("geo", F.lit(place))
    return joined.select(*CENSUS_COLUMNS)


def individual_census(individuals: DataFrame, coordinates: DataFrame, place: str) -> DataFrame:
    """Census kept as individuals, with household positions in UTM metres.

    ``coordinates`` has ``house_number``, ``lat`` (northing) and ``lng`` (easting);
    people without a position pass through.
    """
    people = individuals.select(
        F.col("lastName").alias("permid"),
        F.col("dob").cast("date").alias("dob"),
        recode.recode(F.col("gender"), K.INDIVIDUAL_GENDER).alias("gender"),
        F.col("firstName").alias("name"),
        keys.household_of(F.col("lastName")).alias("house_number"),
    )
    placed = coordinates.select("house_number", "lat", "lng")
    return reproject(people.join(placed, "house_number", "left")).withColumn(
        "geo", F.lit(place)
    ).select(*CENSUS_COLUMNS)


def reproject(df: DataFrame, easting: str = "lng", northing: str = "lat") -> DataFrame:
    """UTM metres to degrees; a position with one missing part keeps its values."""
    lng, lat = geo.utm_to_lonlat(F.col(easting), F.col(northing))
    both = F.col(easting).isNotNull() & F.col(northing).isNotNull()
    return df.withColumns({
        easting: F.when(both, lng).otherwise(F.col(easting)),
        northing: F.when(both, lat).otherwise(F.col(northing)),
    })


def unite_census(censuses: Sequence[DataFrame], order: Sequence[Column] | None = None) -> DataFrame:
    """One census, one row per permid: earlier censuses win, then ``order``.

    All NULL permids count as one key.
    """
    ranked = joins.union_all([c.withColumn("__rank", F.lit(i)) for i, c in enumerate(censuses)])
    within = order or [F.col(c) for c in ("house_number", "name", "dob", "lng", "lat")]
    return keep_first(ranked, ["permid"], [F.col("__rank"), *within]).drop("__rank")


def link_exact(students: DataFrame, census: DataFrame, null_safe: bool = False) -> DataFrame:
    """Add census attributes to students of the same permid and gender.

    Genders are compared in upper case. The census must hold one row per permid;
    its name is not taken over.
    """
    people = census.withColumnRenamed("permid", "PERMID").withColumn(
        "gender", keys.match_gender(F.col("gender"))
    ).drop("name")
    folded = students.withColumn("gender", keys.match_gender(F.col("gender")))
    return joins.left_join(folded, people, ["PERMID", "gender"], null_safe)


def link_fuzzy(
    students: DataFrame, census: DataFrame, max_distance: int | None = None,
    name: str = "name", gender: str = "gender", person: str = "permid",
) -> DataFrame:
    """Nearest census name of the same gender, at any edit distance.

    Adds ``match_name``, ``match_distance`` and ``match_person``; NULL without a
    name, a gender or a census name of that gender, and for matches that
    ``max_distance`` does not accept (:func:`open_names` lists all those). Ties
    go to the name first in order, then to the smallest person id.

    Both sides are first reduced to distinct names, so a name shared by a third of all
    people is looked up once. :func:`names.nearest` finds it in an index.
    """
    wanted = students.select(F.col(gender).alias("g"), F.col(name).alias("n")).dropna().distinct()
    offered = census.select(
        F.col(gender).alias("g"), F.col(name).alias("m"), F.col(person).alias("p")
    ).dropna(subset=["g", "m"]).groupBy("g", "m").agg(F.min("p").alias("p"))
    found = names.nearest(wanted, offered, max_distance)
    matched = found.select(
        F.col("g").alias(gender), F.col("n").alias(name), F.col("m").alias("match_name"),
        F.col("d").alias("match_distance"), F.col("p").alias("match_person"),
    )
    return students.join(matched, [gender, name], "left")


def open_names(
    linked: DataFrame, census: DataFrame, max_distance: int | None = None, name: str = "name", gender: str = "gender",
) -> DataFrame:
    """Names that :func:`link_fuzzy` left open, with the number of people and a reason."""
    genders = census.dropna(subset=[gender, name]).select(F.col(gender).alias("__known")).distinct()
    left = linked.filter(F.col("match_name").isNull()).groupBy(gender, name).agg(F.count(F.lit(1)).alias("people"))
    reason = (
        F.when(F.col(name).isNull(), "no name").when(F.col(gender).isNull(), "no gender")
        .when(F.col("__known").isNull(), "gender absent from the census")
        .otherwise(f"no name within {max_distance} letters")
    )
    return left.join(genders, F.col(gender) == F.col("__known"), "left").select(gender, name, "people", reason.alias("reason"))


def link_nearest(
    linked: DataFrame, census: DataFrame, max_distance: int | None = 4, name: str = "NAME",
    attributes: Sequence[str] = ("lng", "lat"),
) -> DataFrame:
    """Positions of the nearest census name for students that exact linkage left without.

    Adds ``perfect_match_in_census`` and ``approximate_match_in_census``: the position was
    there already or belongs to a person of that very name; it belongs to one whose name
    differs in some letters. Adds ``match_name`` and ``match_distance`` of the nearest name
    at any distance; its position is taken, and flagged, if ``max_distance`` accepts it
    (None: always). The census must hold one row per permid.
    """
    # Columns by place: exact linkage may leave names that differ in case only.
    place = {c: f"__{i}" for i, c in enumerate(linked.columns)}
    rows = linked.toDF(*(f"__{i}" for i in range(len(linked.columns))))
    own, sex, held = place[name], place["gender"], [place[c] for c in attributes]
    people = census.select(
        keys.match_gender(F.col("gender")).alias(sex), F.col("name").alias(own), "permid",
        *(F.col(c).alias(f"__found_{c}") for c in attributes),
    ).filter(F.col(f"__found_{attributes[0]}").isNotNull())
    near = link_fuzzy(rows.filter(F.col(held[0]).isNull()), people, None, own, sex)
    accepted = F.lit(True) if max_distance is None else F.col("match_distance") <= max_distance
    taken = people.select(F.col("permid").alias("match_person"), *(f"__found_{c}" for c in attributes))
    near = near.join(taken, "match_person", "left").withColumns(
        {h: F.when(accepted, F.coalesce(h, f"__found_{c}")).otherwise(F.col(h)) for h, c in zip(held, attributes)}
    )
    flags = {
        "perfect_match_in_census": F.coalesce(F.col("match_distance") == 0, F.lit(False)),
        "approximate_match_in_census": F.coalesce(accepted & (F.col("match_distance") > 0), F.lit(False)),
    }
    nearest = {"match_name": "string", "match_distance": "int"}
    near = near.withColumns(flags).select(*rows.columns, *flags, *nearest)
    rest = rows.filter(F.col(held[0]).isNotNull()).withColumns(
        dict(zip(flags, (F.lit(True), F.lit(False)))) | {c: F.lit(None).cast(t) for c, t in nearest.items()}
    )
    return rest.unionByName(near).toDF(*linked.columns, *flags, *nearest)
