"""The given tables, shaped as the news feeds the operators read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.binding import bind

AS_OF = dt.date(2024, 1, 30)


# declared, so that no job has to read a footer to plan a query
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def as_feed(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of any kind (batch or stream) as the events feed."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = (
        events.join(customer, F.col("user_id") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    no = lambda n: F.col("event_id") % n == 0
    text = lambda c: F.col(c).cast("string")
    feed = joined.select(
        F.date_format("ts", "yyyyMMdd").cast("bigint").alias("SQLDATE"),
        _unless(no(10), F.col("n_name")).alias("ActionGeo_CountryCode"),
        _unless(no(50), F.col("r_name")).alias("Actor1Geo_CountryCode"),
        _unless(no(100), F.col("c_mktsegment")).alias("Actor2Geo_CountryCode"),
        _unless(no(10), F.concat("n_name", F.lit("-1"))).alias("ActionGeo_ADM1Code"),
        _unless(no(50), F.concat("r_name", F.lit("-2"))).alias("Actor1Geo_ADM1Code"),
        _unless(no(100), F.concat("c_mktsegment", F.lit("-3"))).alias("Actor2Geo_ADM1Code"),
        _unless(no(10), F.col("n_nationkey") + 0.5).alias("ActionGeo_Lat"),
        _unless(no(50), F.col("n_nationkey") + 0.25).alias("Actor1Geo_Lat"),
        _unless(no(100), F.col("n_nationkey") + 0.125).alias("Actor2Geo_Lat"),
        _unless(no(10), F.col("n_nationkey") - 0.5).alias("ActionGeo_Long"),
        _unless(no(50), F.col("n_nationkey") - 0.25).alias("Actor1Geo_Long"),
        _unless(no(100), F.col("n_nationkey") - 0.125).alias("Actor2Geo_Long"),
        F.concat(F.lit("0"), "event_type", F.lit("11")).alias("EventCode"),
        F.concat(F.lit("0"), "event_type", F.lit("1")).alias("EventBaseCode"),
        _unless(no(89), F.concat(F.lit("0"), "event_type")).alias("EventRootCode"),
        _unless(no(83), (F.lit(50) - F.col("value")) / 10).alias("AvgTone"),
        _unless(
            no(97), F.concat(F.lit("http://news.example/d/"), F.floor(F.col("event_id") / 20))
        ).alias("SOURCEURL"),
    )
    return feed


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_feed(table(spark, sf_dir, "events"), spark, sf_dir)


def gkg_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge-graph rows; every word of the whole text is in one of three fields."""
    docs = table(spark, sf_dir, "documents")
    id = F.col("doc_id")

    def entries(step: int, first: int, name, separator: str) -> Column:
        """Every ``step``-th word as ``name,position``; only those words are touched."""

        def numbered(words: Column) -> Column:
            last = F.greatest(F.size(words) - 1, F.lit(first))
            # a text with too few words has no such place: NULL, which the join skips
            entry = lambda i: F.when(
                i < F.size(words), F.concat(name(words[i], i), F.lit(","), i.cast("string"))
            )
            places = F.sequence(F.lit(first), last, F.lit(step))
            return F.array_join(F.transform(places, entry), separator)

        return bind(F.split("text", " "), numbered)

    def theme(w: Column, i: Column) -> Column:
        kind = i % 16
        return (
            F.when(kind == 0, F.concat(F.lit("USPEC_"), w))
            .when(kind == 4, F.concat(F.lit("WB_12_"), w))
            .when(kind == 8, F.concat(F.lit("TAX_FNCACT_"), w))
            .when(kind == 12, F.concat(F.lit("CRISISLEX_"), w))
            .otherwise(w)
        )

    def person(w: Column, i: Column) -> Column:
        return F.when(i % 30 == 1, "Los Angeles").when(i % 30 == 4, "Facebook").otherwise(w)

    day = F.lit(20240101) + id % 30
    return docs.select(
        (day * 1000000 + id % 24 * 10000).cast("bigint").alias("date"),
        F.concat(F.lit("http://news.example/d/"), F.floor(id / 2)).alias("DocumentIdentifier"),
        entries(3, 0, theme, ";").alias("V2Themes"),
        _unless(id % 7 == 0, entries(3, 1, person, "; ")).alias("V2Persons"),
        _unless(id % 11 == 0, entries(3, 2, lambda w, i: w, " ;\t")).alias("V2Organizations"),
    )


HOT_URL = "http://news.example/hot"


def _hot(url: str, every: int) -> Column:
    """One url in the place of every so many."""
    number = F.substring_index(url, "/", -1).cast("bigint")
    return F.when(number % every == 0, HOT_URL).otherwise(F.col(url))


def hot_events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events feed with one url for a third of the events."""
    return events_feed(spark, sf_dir).withColumn("SOURCEURL", _hot("SOURCEURL", 3))


def hot_gkg_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph feed with that url for every 125th pair of documents."""
    return gkg_feed(spark, sf_dir).withColumn("DocumentIdentifier", _hot("DocumentIdentifier", 125))


def shifted_events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events feed; of every 50 urls one is a hundred years ahead, and one behind."""
    number = F.substring_index("SOURCEURL", "/", -1).cast("bigint") % 50
    years = F.when(number == 3, 100).when(number == 4, -100).otherwise(0)
    return events_feed(spark, sf_dir).withColumn("SQLDATE", F.col("SQLDATE") + years * 10000)


def dated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one document vector per (day, country)."""
    id = F.col("vec_id")
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (id % 30).cast("int"))
    country = F.concat(F.lit("C"), F.floor(id / 30))
    return table(spark, sf_dir, "embeddings").select(
        day.alias("event_date"),
        country.alias("country"),
        F.concat(
            F.lit("Vector "), id, F.lit(" at https://news.example/v/"), id, F.lit(" of "), "label"
        ).alias("topic_doc"),
        "embedding",
        F.concat(country, F.lit("-"), day).alias("id"),
        F.col("label").cast("bigint").alias("headline_count"),
    )


def country_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("code"),
        key.alias("iso2"),
        F.concat(F.lit("N"), key).alias("iso3"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("region"),
    )


def dated_country_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension with days: on January 15th every other nation comes to a new region."""
    dim = country_dim(spark, sf_dir)
    moved = dim.where(F.col("iso2").cast("int") % 2 == 0)
    return dim.withColumn("valid_from", F.lit("2024-01-05")).unionByName(
        moved.withColumns({"region": F.concat(F.lit("NEW "), "region"), "valid_from": F.lit("2024-01-15")})
    )


def paged_events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events feed; urls with the number of a page become the page's, spelled in four ways."""
    feed = events_feed(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    bare = F.regexp_replace("page_url", "#.*$", "")
    spelled = (
        F.when(F.col("page_id") % 4 == 1, F.regexp_replace("page_url", "^https?://", "HTTPS://WWW."))
        .when(F.col("page_id") % 4 == 2, F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_source=feed")))
        .when(F.col("page_id") % 4 == 3, F.regexp_replace("page_url", "^(https?://[^/?#]+)", "$1:443"))
        .otherwise(F.col("page_url"))
    )
    number = F.substring_index("SOURCEURL", "/", -1).cast("bigint")
    joined = feed.join(pages.select("page_id", spelled.alias("page_url")), number == F.col("page_id"), "left")
    return joined.withColumn("SOURCEURL", F.coalesce("page_url", "SOURCEURL")).drop("page_id", "page_url")
