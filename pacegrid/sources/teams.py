"""The car number to team lookup."""

from pyspark.sql import DataFrame, SparkSession

# Team code and its two car numbers.
TEAMS = {
    "EVR": (4, 37),
    "MEQ": (5, 17),
    "DRA": (6, 7),
    "NIO": (8, 88),
    "JR": (10, 20),
    "AUDI": (11, 33),
    "DS": (13, 25),
    "NIS": (22, 23),
    "BMW": (27, 28),
    "MAH": (29, 94),
    "TAG": (36, 99),
    "ROK": (48, 71),
}


def team_lookup(spark: SparkSession) -> DataFrame:
    rows = [(number, team) for team, numbers in TEAMS.items() for number in numbers]
    return spark.createDataFrame(rows, "NUMBER int, TEAM string")
