"""Fixed dimensions: ballot rows, contests, curated stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import CATEGORY_LABELS

# Ballot rows in printed order; rows 4 and 14 are blank.
BALLOT = [
    (1, "ALIANZA ELECTORAL VENCEREMOS"),
    (2, "PARTIDO PATRIOTICO DEL PERU"),
    (3, "PARTIDO CIVICO OBRAS"),
    (4, ""),
    (5, "PARTIDO DEMOCRATA VERDE"),
    (6, "PARTIDO DEL BUEN GOBIERNO"),
    (7, "PARTIDO POLITICO PERU ACCION"),
    (8, "PARTIDO POLITICO PRIN"),
    (9, "PROGRESEMOS"),
    (10, "PARTIDO SICREO"),
    (11, "PARTIDO PAIS PARA TODOS"),
    (12, "FRENTE DE LA ESPERANZA 2021"),
    (13, "PARTIDO POLITICO NACIONAL PERU LIBRE"),
    (14, ""),
    (15, "PRIMERO LA GENTE"),
    (16, "JUNTOS POR EL PERU"),
    (17, "PODEMOS PERU"),
    (18, "PARTIDO DEMOCRATICO FEDERAL"),
    (19, "FE EN EL PERU"),
    (20, "PARTIDO POLITICO INTEGRIDAD DEMOCRATICA"),
    (21, "FUERZA POPULAR"),
    (22, "ALIANZA PARA EL PROGRESO"),
    (23, "PARTIDO POLITICO COOPERACION POPULAR"),
    (24, "AHORA NACION - AN"),
    (25, "LIBERTAD POPULAR"),
    (26, "UN CAMINO DIFERENTE"),
    (27, "AVANZA PAIS"),
    (28, "PERU MODERNO"),
    (29, "PARTIDO POLITICO PERU PRIMERO"),
    (30, "SALVEMOS AL PERU"),
    (31, "PARTIDO DEMOCRATICO SOMOS PERU"),
    (32, "PARTIDO APRISTA PERUANO"),
    (33, "RENOVACION POPULAR"),
    (34, "PARTIDO DEMOCRATA UNIDO PERU"),
    (35, "FUERZA Y LIBERTAD"),
    (36, "PTE - PERU"),
    (37, "UNIDAD NACIONAL"),
    (38, "PARTIDO MORADO"),
]

# Contests by id.
CONTESTS = [
    (10, "Presidencial"),
    (12, "Parlamento Andino"),
    (13, "Diputados"),
    (14, "Senadores DEM"),
    (15, "Senadores DEU"),
]

# Curated stations and their category.
CURATED = [
    ("054938", "normal"),
    ("053938", "normal"),
    ("013571", "sospecha"),
    ("013064", "sospecha"),
    ("033019", "sospecha"),
    ("050618", "incidencia"),
    ("050619", "incidencia"),
    ("050620", "incidencia"),
    ("050627", "incidencia"),
    ("036940", "analisis"),
    ("027420", "referencia"),
    ("055709", "observada"),
    ("050569", "observada"),
]

# Keywords of the discrepancy chart.
CHART_PARTIES = [
    "ALIANZA PARA EL PROGRESO",
    "AVANZA PAIS",
    "FUERZA POPULAR",
    "PERU LIBRE",
    "SOMOS PERU",
    "PARTIDO DEMOCRATICO SOMOS PERU",
    "PTE-PERU",
    "RENOVACION POPULAR",
    "PARTIDO PAIS PARA TODOS",
]


def dim_parties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BALLOT, "row INT, party STRING")


def dim_contests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTESTS, "contest_id INT, contest STRING")


def dim_curated(spark: SparkSession) -> DataFrame:
    rows = [(station, cat, CATEGORY_LABELS[cat]) for station, cat in CURATED]
    return spark.createDataFrame(rows, "station STRING, category STRING, category_label STRING")


def with_contest_name(df: DataFrame, contests: DataFrame) -> DataFrame:
    """Contest name from the five-row dimension, with the numbered fallback."""
    from ..functions.values import contest_name

    named = df.join(F.broadcast(contests.select("contest_id", F.col("contest").alias("_c"))),
                    "contest_id", "left")
    return named.withColumn("contest_name", contest_name(F.col("_c"), F.col("contest_id"))).drop("_c")
