"""Column lists and types of the flight pipeline."""

from pyspark.sql import types as T

# Columns of the monthly on-time files by target type.
INT_COLUMNS = (
    "YEAR", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "CRS_DEP_TIME", "DEP_TIME", "CRS_ARR_TIME", "ARR_TIME",
    "DEP_DEL15", "ARR_DEL15", "CANCELLED", "DIVERTED", "DUP", "DISTANCE_GROUP", "DIV_AIRPORT_LANDINGS",
    "DIV_REACHED_DEST",
)
DOUBLE_COLUMNS = (
    "DEP_DELAY", "DEP_DELAY_NEW", "ARR_DELAY", "ARR_DELAY_NEW", "TAXI_OUT", "TAXI_IN", "AIR_TIME",
    "ARR_DELAY_GROUP", "DEP_DELAY_GROUP", "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY", "DISTANCE", "FLIGHTS", "ACTUAL_ELAPSED_TIME", "CRS_ELAPSED_TIME",
)
FILLED_DELAYS = (
    "ARR_DELAY_NEW", "DEP_DELAY_NEW", "CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY",
    "LATE_AIRCRAFT_DELAY",
)

# Model features, in vector order (numbers first, then categories).
NUMERIC_FEATURES = (
    "month", "day_of_month", "day_of_week", "crs_dep_time", "crs_arr_time", "distance", "crs_elapsed_time",
)
CATEGORICAL_FEATURES = ("op_unique_carrier", "origin", "dest")
TARGET = "arr_del15"
INT_FEATURES = ("month", "day_of_month", "day_of_week", "crs_dep_time", "crs_arr_time")
DOUBLE_FEATURES = ("distance", "crs_elapsed_time")

# Fixed values, stream message: ten nullable strings, upper-case names as on the wire.
MESSAGE_COLUMNS = (
    "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "CRS_DEP_TIME", "CRS_ARR_TIME", "CRS_ELAPSED_TIME", "DISTANCE", "MONTH",
    "DAY_OF_MONTH", "DAY_OF_WEEK",
)
MESSAGE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in MESSAGE_COLUMNS])

CARRIER_FILE_SCHEMA = T.StructType(
    [T.StructField("Code", T.StringType(), True), T.StructField("Description", T.StringType(), True)]
)

# Names shown to readers of a report.
FRIENDLY_NAMES = {
    "dest_indexed": "Destination Airport", "origin_indexed": "Origin Airport", "op_unique_carrier_indexed": "Airline",
    "day_of_month": "Day of Month", "crs_dep_time": "Departure Time", "crs_arr_time": "Arrival Time",
    "distance": "Flight Distance", "crs_elapsed_time": "Flight Duration", "month": "Month",
    "day_of_week": "Day of Week",
}
MONTH_NAMES = dict(enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1))
WEEKDAY_NAMES = dict(enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), 1))
OUTCOME_NAMES = {0: "On-time", 1: "Delayed"}

# Event kinds of the trajectory fixture and the role each one plays.
TAKE_OFF, LANDING, LEVEL, TAXI, PARKING = "signup", "purchase", "view", "click", "error"
EXPECTED_EVENTS = (TAKE_OFF, LANDING, LEVEL, TAXI, PARKING)
