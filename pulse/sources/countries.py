"""Country dimension, taken from the JDK's ISO 3166 data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.schemas import COUNTRY_DIM


def iso_countries(spark: SparkSession) -> DataFrame:
    """(code, iso2, iso3, name, region), one row per ISO-2 code (about 250)."""
    locale = spark._jvm.java.util.Locale
    rows = []
    for iso2 in locale.getISOCountries():
        country = locale("", iso2)
        rows.append(
            (iso2, iso2, country.getISO3Country(), country.getDisplayCountry(locale.ENGLISH), None)
        )
    return spark.createDataFrame(rows, COUNTRY_DIM)


def fips_countries(iso: DataFrame, fips_codes: DataFrame) -> DataFrame:
    """The dimension keyed by FIPS 10-4 codes; ``fips_codes`` is (fips, iso2).

    Event feeds carry FIPS codes, some of which are another country's ISO code.
    Use this in place of ``iso_countries`` to read them as what they are.
    """
    return iso.drop("code").join(fips_codes.select(F.col("fips").alias("code"), "iso2"), "iso2")


def dated_countries(iso: DataFrame, codes: DataFrame) -> DataFrame:
    """The dimension keyed by the codes of a feed, with regions and the days they hold from.

    ``codes`` is (code, iso2, region, valid_from); a code that came to mean another country
    has several rows. An iso2 that ``iso`` does not know keeps its region, with NULL iso3 and name.
    """
    known = codes.select("code", "iso2", "region", F.to_date("valid_from").alias("valid_from"))
    return known.join(iso.drop("code", "region"), "iso2", "left").select(
        "code", "iso2", "iso3", "name", "region", "valid_from"
    )


def read_countries(spark: SparkSession, location: str) -> DataFrame:
    """``dated_countries`` from a CSV file with the header code, iso2, region, valid_from."""
    codes = spark.read.option("header", True).csv(location)
    return dated_countries(iso_countries(spark), codes)
