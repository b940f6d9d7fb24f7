"""Constant tables, carried as data.

Each is a fixed, small literal; joins to them are broadcast by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swapledger.operators.teams import TAX_THRESHOLD

# Master id, short code, code, full name and division of every club.
TEAMS = [
    (108, "LAA", "LAA", "Los Angeles Angels", "AL West"),
    (109, "AZ", "ARI", "Arizona Diamondbacks", "NL West"),
    (110, "BAL", "BAL", "Baltimore Orioles", "AL East"),
    (111, "BOS", "BOS", "Boston Red Sox", "AL East"),
    (112, "CHC", "CHC", "Chicago Cubs", "NL Central"),
    (113, "CIN", "CIN", "Cincinnati Reds", "NL Central"),
    (114, "CLE", "CLE", "Cleveland Guardians", "AL Central"),
    (115, "COL", "COL", "Colorado Rockies", "NL West"),
    (116, "DET", "DET", "Detroit Tigers", "AL Central"),
    (117, "HOU", "HOU", "Houston Astros", "AL West"),
    (118, "KC", "KCR", "Kansas City Royals", "AL Central"),
    (119, "LAD", "LAD", "Los Angeles Dodgers", "NL West"),
    (120, "WSH", "WSN", "Washington Nationals", "NL East"),
    (121, "NYM", "NYM", "New York Mets", "NL East"),
    (133, "ATH", "OAK", "Athletics", "AL West"),
    (134, "PIT", "PIT", "Pittsburgh Pirates", "NL Central"),
    (135, "SD", "SDP", "San Diego Padres", "NL West"),
    (136, "SEA", "SEA", "Seattle Mariners", "AL West"),
    (137, "SF", "SFG", "San Francisco Giants", "NL West"),
    (138, "STL", "STL", "St. Louis Cardinals", "NL Central"),
    (139, "TB", "TBR", "Tampa Bay Rays", "AL East"),
    (140, "TEX", "TEX", "Texas Rangers", "AL West"),
    (141, "TOR", "TOR", "Toronto Blue Jays", "AL East"),
    (142, "MIN", "MIN", "Minnesota Twins", "AL Central"),
    (143, "PHI", "PHI", "Philadelphia Phillies", "NL East"),
    (144, "ATL", "ATL", "Atlanta Braves", "NL East"),
    (145, "CWS", "CHW", "Chicago White Sox", "AL Central"),
    (146, "MIA", "MIA", "Miami Marlins", "NL East"),
    (147, "NYY", "NYY", "New York Yankees", "AL East"),
    (158, "MIL", "MIL", "Milwaukee Brewers", "NL Central"),
]

# Codes of renamed clubs and the master id they continue as.
HISTORICAL_CODES = {"FLA": 146, "MON": 120, "TBD": 139, "ANA": 108}

# Price of one unit of value by season, used where no market price can be computed.
SEASON_PRICE = {
    2010: 4_500_000, 2011: 5_000_000, 2012: 5_500_000, 2013: 6_000_000, 2014: 6_500_000,
    2015: 7_500_000, 2016: 8_000_000, 2017: 8_500_000, 2018: 9_000_000, 2019: 9_000_000,
    2020: 8_000_000, 2021: 8_500_000, 2022: 9_000_000, 2023: 9_500_000, 2024: 10_000_000,
}


def team_master(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEAMS, "master_id int, short_code string, code string, name string, division string")


def team_codes(spark: SparkSession) -> DataFrame:
    """Every known code, current or historical, with its master id."""
    rows = [(t[2], t[0]) for t in TEAMS] + list(HISTORICAL_CODES.items())
    return spark.createDataFrame(rows, "code string, team_id int")


def tax_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAX_THRESHOLD.items()), "season int, threshold long")


def season_prices(spark: SparkSession) -> DataFrame:
    rows = [(s, float(p)) for s, p in SEASON_PRICE.items()]
    return spark.createDataFrame(rows, "season int, price double")
