"""Small inline relations. Their contents are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Labelled sample: address, clicks, really a bot, kind of user.
LABELLED_SAMPLE = (
    ("10.1.1.1", 150, True, "Script_Bot"),
    ("10.1.1.2", 200, True, "Script_Bot"),
    ("10.1.1.3", 180, True, "Script_Bot"),
    ("10.1.1.4", 160, True, "Script_Bot"),
    ("10.1.1.5", 140, True, "Script_Bot"),
    ("192.168.1.1", 5, False, "Normal_User"),
    ("192.168.1.2", 12, False, "Normal_User"),
    ("192.168.1.3", 25, False, "Normal_User"),
    ("192.168.1.4", 8, False, "Normal_User"),
    ("192.168.1.5", 15, False, "Normal_User"),
    ("192.168.1.6", 20, False, "Normal_User"),
    ("172.16.0.1", 55, False, "Gamer_User"),
    ("172.16.0.2", 62, False, "Heavy_Shopper"),
    ("172.16.0.3", 51, False, "Family_Shared_IP"),
    ("172.16.0.4", 70, False, "Gamer_User"),
    ("172.16.0.5", 80, False, "Heavy_Shopper"),
    ("10.9.9.1", 45, True, "Low_and_Slow_Bot"),
    ("10.9.9.2", 48, True, "Mimic_Bot"),
    ("10.9.9.3", 49, True, "AI_Crawler"),
    ("10.9.9.4", 47, True, "Low_and_Slow_Bot"),
    ("10.9.9.5", 46, True, "Stealth_Bot"),
)

# Map position per country: code, latitude, longitude. Unknown codes sit at (0, 0).
COUNTRY_POSITIONS = (
    ("US", 37.0902, -95.7129),
    ("CN", 35.8617, 104.1954),
    ("RU", 61.5240, 105.3188),
    ("BR", -14.2350, -51.9253),
    ("IN", 20.5937, 78.9629),
    ("DE", 51.1657, 10.4515),
    ("GB", 55.3781, -3.4360),
    ("FR", 46.2276, 2.2137),
)


def labelled_sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(LABELLED_SAMPLE),
        "ip_address string, total_clicks bigint, is_actually_bot boolean, user_type string",
    )


def country_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRY_POSITIONS), "country_code string, lat double, lon double")
