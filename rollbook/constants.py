"""Codes, labels, dates and thresholds the results depend on."""

from __future__ import annotations

# --- fixed values: coded answers of the school form -------------------------
SCHOOL_CONDITIONS = {
    1: "Caniço e palha",
    2: "Caniço e chapa de zinco",
    3: "Matope e palha",
    4: "Matope e chapa de zinco",
    5: "Madeira e zinco",
    6: "Convencional e outras precárias",
    7: "Todas de material convencional",
    8: "Outro",
}
TYPE_OF_LATRINE = {
    1: "Retrete ligada a fossa séptica",
    2: "Latrine Melhorada",
    3: "Latrina tradicional melhorada",
    4: "Latrina tradicional não melhorada",
    5: "Sem latrina",
}
LUNCH = {1: True, 2: False}
DISTRICT = {1: "Manhiça", 2: "Magude"}
GENDER = {1: "Male", 2: "Female"}
MEMBER_GENDER = {"1": "male", "2": "female"}
INDIVIDUAL_GENDER = {"M": "male", "F": "female"}

# --- fixed values: names ----------------------------------------------------
MISSING_SCHOOL_NAME = "EPC xUngucha"
DUPLICATE_SCHOOL_NAME = "EPC Mulembja "

# --- fixed values: calendar -------------------------------------------------
PHASE_1_YEAR = 2015
PHASE_1_START, PHASE_1_END = "2015-03-01", "2015-12-31"
PHASE_2_YEAR = 2016
PHASE_2_START, PHASE_2_END = "2016-02-01", "2016-06-30"
HOLIDAYS = ("2016-05-01", "2016-06-25")
BREAK_MONTHS = (12, 1)
THIRD_SLOT_FIX = {1: 9}
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
CALENDAR_MONTHS = {"fev": 2, "march": 3, "april": 4, "may": 5, "jun": 6}
CALENDAR_SYMBOLS = {
    "fev": "february_b",
    "march": "march_b",
    "april": "april_b",
    "may": "may",
    "jun": "june",
}

# --- fixed values: actions of the class-month decision table ----------------
NOT_USABLE = "not_usable"
LECTIVE_DAYS = "lective_days"
DAYS_OFF = "days_off"
FROM_SCRATCH = "from_scratch"
DAYS_OFF_MONTHS = ("fev", "march", "april")
FROM_SCRATCH_MONTHS = ("may", "jun")

# --- fixed values: trimester letters of the evaluation columns --------------
LETTER_YEAR = {"a": 2015, "b": 2015, "c": 2015, "d": 2016}
LETTER_TRIMESTER = {"a": 1, "b": 2, "c": 3, "d": 4}
MARK_TOKEN = "avaliation"
MARK_SUBJECT_START = 22
MARK_PERIODS = ("mt", "ap")
MARK_YEARS = ("2015", "2016")
ETHICS_COLUMNS = ("days_off_august", "day_off_august")
ETHICS_SUBJECT = "etica"

# --- fixed values: thresholds -----------------------------------------------
MIN_WEEKLY_RATE = 1.0
DAYS_PER_WEEK = 5
ROLLING_DAYS = 30
MIN_STUDENTS = 10
RATIO_BOUNDS = (20.0, 400.0)
VISITED_ABOVE = 5
COLLECTED_ABOVE = 10
MANY_ABSENCES = 18
EXPECTED_SCHOOLS = 25
REFERENCE_MONTHS = (4, 11)
DAYS_OFF_RANGE = (8, 15)
TEACHER_AGES = (18, 70)
MAX_HOME_KM = 50.0

# --- fixed values: geography and travel -------------------------------------
DEGREE_SCALE = 1e10
ORIGIN_LNG, ORIGIN_LAT = 32.803869, -25.408462
SPHERE_RADIUS_KM = 6378.137
FUEL_EUROS_PER_LITRE = 0.6
WEAR_EUROS = 0.2
KM_PER_LITRE = 7.0
UTM_CENTRAL_MERIDIAN = 33.0
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
UTM_FALSE_NORTHING = 10_000_000.0
WGS84_RADIUS = 6_378_137.0
WGS84_FLATTENING = 1 / 298.257223563

EXCEL_ORIGIN = "1899-12-30"
