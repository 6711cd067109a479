"""A bundled lookup from official building functions to building tags, put together from public tagging practice.

A value of "-" marks what is no building of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: German names of building functions and the tag of each (fixed values).
BUILDING_FUNCTIONS = """
Wohngebäude;residential
Wohnhaus;house
Einfamilienhaus;detached
Reihenhaus;terrace
Doppelhaushälfte;semidetached_house
Mehrfamilienhaus;apartments
Wohnheim;dormitory
Studentenwohnheim;dormitory
Bauernhaus;farm
Wochenendhaus;cabin
Gartenhaus;shed
Bürogebäude;office
Verwaltungsgebäude;government
Rathaus;townhall
Gericht;government
Kaufhaus;retail
Laden;retail
Supermarkt;supermarket
Hotel;hotel
Gaststätte;commercial
Fabrik;industrial
Werkstatt;industrial
Lagerhalle;warehouse
Kühlhaus;warehouse
Garage;garage
Tiefgarage;-
Parkhaus;parking
Carport;carport
Schuppen;shed
Scheune;barn
Stall;sty
Gewächshaus;greenhouse
Silo;silo
Kirche;church
Kapelle;chapel
Moschee;mosque
Synagoge;synagogue
Kloster;monastery
Schule;school
Hochschule;university
Kindergarten;kindergarten
Krankenhaus;hospital
Museum;museum
Theater;theatre
Sporthalle;sports_hall
Hallenbad;sports_centre
Stadion;stadium
Feuerwehr;fire_station
Bahnhof;train_station
Bootshaus;boathouse
Umspannwerk;service
Trafostation;transformer_tower
Wasserturm;water_tower
Pumpwerk;service
Bunker;bunker
Turm;tower
Ruine;ruins
Toilette;toilets
Durchfahrt;-
Vordach;-
Terrasse;-
Rampe;-
"""


def building_functions(spark: SparkSession) -> DataFrame:
    """key (lower case), value."""
    rows = [tuple(line.rsplit(";", 1)) for line in BUILDING_FUNCTIONS.split("\n") if line.strip()]
    return spark.createDataFrame([(k.strip().lower(), v.strip()) for k, v in rows], "key string, value string")
