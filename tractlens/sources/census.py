"""Census-office tables: the tract workbook as CSV, municipal figures, polygon layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.operators.labels import GRADES, SOURCE_GRADES

# fixed values: columns of the census workbook in its order
INDICATORS = (
    "analfabeta",
    "sin_escuela_6_14",
    "sin_escuela_15_24",
    "basica_incompleta",
    "sin_salud",
    "hacinamiento",
    "sin_agua",
    "sin_excusado",
    "sin_drenaje",
    "sin_electricidad",
    "piso_tierra",
    "sin_lavadora",
    "sin_refrigerador",
    "sin_telefono",
    "sin_celular",
    "sin_computadora",
    "sin_internet",
)
COLUMNS = (
    "state_key",
    "state_name",
    "municipality_key",
    "municipality_name",
    "locality_key",
    "locality_name",
    "folio",
    "cvegeo",
    "population",
    "dwellings",
    *INDICATORS,
    "grade",
)
# the five digits of a municipality and the places of a tract; titles, headers, dates and notes have no such form
KEY_PATTERN = "^\\s*[0-9]{5}[0-9A-Z]{4,}\\s*$"


def number(text: Column) -> Column:
    """A decimal written with a comma or a point; anything else is null."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def read_tracts(spark: SparkSession, path: str) -> DataFrame:
    """Tract labels: numbers coerced, grades trimmed, checked, recoded and numbered.

    The title and header rows above the data carry no tract key and fall away with the rows
    without one. An unknown grade on a keyed row stops the job.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    raw = spark.read.schema(schema).csv(path)
    keyed = raw.where(F.col("cvegeo").rlike(KEY_PATTERN)).withColumn("grade", F.trim("grade"))
    names = F.create_map(*[F.lit(x) for pair in SOURCE_GRADES.items() for x in pair])
    known = F.try_element_at(names, F.col("grade"))
    grade = F.when(
        F.col("grade").isNotNull() & known.isNull(),
        F.raise_error(F.concat(F.lit("unexpected grade: "), F.col("grade"))).cast("string"),
    ).otherwise(known)
    order = F.array(*map(F.lit, GRADES))
    return (
        keyed.where(F.col("grade").isNotNull())
        .withColumn("grade", grade)
        .withColumn("ordinal", (F.array_position(order, F.col("grade")) - 1).cast("byte"))
        .withColumns({c: F.col(c).try_cast("double") for c in ("population", "dwellings", *INDICATORS)})
    )


def cached_tracts(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """Reads the CSV once and the Parquet copy afterwards."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(cache)
    except AnalysisException:
        read_tracts(spark, path).write.mode("overwrite").parquet(cache)
        return spark.read.parquet(cache)


def read_semicolon(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A `;`-separated Latin-1 file, all columns as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep=";", encoding="ISO-8859-1", header=True)


def municipal_poverty(raw: DataFrame) -> DataFrame:
    """Poverty percentage to a share, keyed by municipality."""
    return raw.select(
        F.trim("municipality").alias("municipality"),
        F.trim("name").alias("name"),
        (number(F.col("rate")) / 100.0).alias("poor_share"),
    )


def municipal_income(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.trim("municipality").alias("municipality"),
        F.trim("name").alias("name"),
        number(F.col("mean_income")).alias("mean_income"),
        number(F.col("median_income")).alias("median_income"),
        number(F.col("heads")).alias("heads"),
    )


def polygon_layer(layer: DataFrame, renames: dict[str, str], bbox: tuple | None = None, name: str | None = None) -> DataFrame:
    """A layer under the common column names, cut to a box by its bounding-box columns.

    Asking for a name the layer does not hold is an error, not an empty result.
    """
    out = layer.withColumnsRenamed(renames)
    if bbox is not None:
        xmin, ymin, xmax, ymax = bbox
        out = out.where(
            (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
        )
    if name is not None:
        out = out.where(F.col("name") == name)
        if out.isEmpty():
            raise KeyError(f"no polygon named {name!r}")
    return out
