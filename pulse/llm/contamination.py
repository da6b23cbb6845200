"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

Words are runs of digits, ASCII letters with A-Z lower-cased, and non-ASCII characters. A
window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window.

1. The words of all texts are counted, for those terms that stand in an item.
2. Every window names its two rarest places. The postings (text, place) of the terms at
   these places are shifted by the place in the item; where both places of a window have
   postings with the same shift, text and item may run alongside each other.
3. Such alignments go to their texts, and the runs of equal words along them are the exact
   matches.

Postings are kept by a hash of the text, so copies of a text share theirs; every text is
verified on its own words. Items are broadcast only if their texts measure less than
``BROADCAST_BYTES``; otherwise Spark joins terms by shuffle. Null texts have no words; rows
with null ids are matched like others. Items with a null id, null text or no words are left
out; items with equal ids count once. Extra columns pass through; columns named as a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import stored, without

WINDOW = 10
BROADCAST_BYTES = 16 << 20

# What a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _items(benchmark: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    rows = benchmark.select(F.col(item_id).alias("item_id"), word_array(F.col(text_col)).alias("iw"))
    rows = rows.filter(F.col("item_id").isNotNull() & (F.size("iw") > 0)).distinct()
    return rows.select(
        F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", F.least(F.lit(window), F.size("iw")).alias("width")
    )


class _Index:
    """Items with their windows, and the postings of the rarest places."""

    def __init__(self, docs, benchmark, text_col, item_id, item_text, window):
        size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
        self.small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
        items = stored(_items(benchmark, item_id, item_text, window), "items")
        # xxhash64 of the text groups copies; equality of words is checked later
        texts = docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))
        places = items.select("item", F.posexplode("iw").alias("q", "term"))
        terms = self.small(places.select("term").distinct())
        spoken = texts.select(F.explode(word_array(F.col("text"))).alias("term"))
        rarity = spoken.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        rarity = stored(rarity, "rarity")
        ranked = (
            places.join(rarity, "term")
            .groupBy("item")
            .agg(F.collect_list(F.struct("df", "q")).alias("ranked"))  # no longer than an item
            .join(items, "item")
        )
        starts = F.sequence(F.lit(0), F.size("iw") - F.col("width"))

        def rarest(s: Column) -> Column:
            """The two rarest of the window from s; an unseen word gives fewer places than words."""
            inside = F.filter("ranked", lambda r: (r["q"] >= s) & (r["q"] < s + F.col("width")))
            order = F.array_sort(inside)
            first, second = F.get(order, F.lit(0)), F.get(order, F.least(F.lit(1), F.col("width") - 1))
            return F.when(
                F.size(inside) == F.col("width"),
                F.struct(first["q"].alias("p"), second["q"].alias("r")),
            )

        windows = F.array_distinct(F.filter(F.transform(starts, rarest), lambda w: w.isNotNull()))
        self.items = stored(
            ranked.select("item", "item_id", "iw", "width", windows.alias("windows")).filter(F.size("windows") > 0),
            "windows",
        )
        pick = F.flatten(F.transform("windows", lambda w: F.array(w["p"], w["r"])))
        anchors = self.items.select("item", "iw", F.explode(F.array_distinct(pick)).alias("q"))
        anchors = self.small(anchors.select("item", "q", F.get("iw", F.col("q")).alias("term")))
        spoken = texts.select("th", F.posexplode(word_array(F.col("text"))).alias("at", "term"))
        self.postings = spoken.join(anchors, "term").select("th", "item", "at", "q")

    def alignments(self) -> DataFrame:
        """Text, item and shift where both rarest places of a window agree."""
        same = (
            self.postings.groupBy("th", "item", (F.col("at") - F.col("q")).alias("shift"))
            .agg(F.collect_set("q").alias("qs"))  # no more than the places of an item
            .join(self.small(self.items), "item")
        )
        both = F.exists(
            "windows", lambda w: F.array_contains("qs", w["p"]) & F.array_contains("qs", w["r"])
        )
        return same.filter(both).select("th", "item_id", "iw", "width", "shift")


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, text_col="text", item_id="item_id", item_text="text", window=WINDOW
) -> DataFrame:
    """The rows of ``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, items``."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
    docs = without(docs, *added, "__th", "__along", "__words", "__found", "__hit")
    index = _Index(docs, benchmark, text_col, item_id, item_text, window)
    along = index.alignments().groupBy("th").agg(
        F.collect_list(F.struct("item_id", "iw", "width", "shift")).alias("__along")
    )
    along = stored(along.withColumnRenamed("th", "__th"), "alignments")
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    # one plan at every size: alignments grow with the texts
    # exploding one array keeps filters above from evaluating the words once for each use
    rows = keyed.join(along.hint("merge"), "__th", "left")
    rows = rows.withColumn("__words", F.explode(F.array(word_array(F.col(text_col)))))

    def hits(a: Column) -> Column:
        """Places of the text that windows cover along one alignment."""
        place = F.sequence(F.lit(0), F.size(a["iw"]) - 1)
        equal = F.transform(
            place, lambda j: F.coalesce(F.get("__words", a["shift"] + j) == F.get(a["iw"], j), F.lit(False))
        )
        starts = F.filter(
            F.sequence(F.lit(0), F.size(a["iw"]) - a["width"]),
            lambda s: F.forall(F.slice(equal, s + 1, a["width"]), lambda x: x),
        )
        return F.flatten(
            F.transform(starts, lambda s: F.sequence(a["shift"] + s, a["shift"] + s + a["width"] - 1))
        )

    found = F.transform(
        "__along", lambda a: F.struct(a["item_id"].alias("item_id"), F.array_distinct(hits(a)).alias("at"))
    )
    rows = rows.withColumn("__found", F.filter(found, lambda x: F.size(x["at"]) > 0))
    items = F.coalesce(
        F.array_sort(F.array_distinct(F.transform("__found", lambda x: x["item_id"].cast("string")))),
        F.array().cast("array<string>"),
    )
    n_hit = F.coalesce(
        F.size(F.array_distinct(F.flatten(F.transform("__found", lambda x: x["at"])))), F.lit(0)
    )
    n_hit = F.when(F.col("__along").isNull(), 0).otherwise(n_hit).cast("long")
    rows = rows.withColumn("items", items).withColumn("n_hit", n_hit)
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("__words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, within=20, text_col="text", item_id="item_id", item_text="text"
) -> DataFrame:
    """``text_hash, item_id, first, last``: postings of two different rarest places of an item
    that follow each other in a text within ``within`` words. The hash is xxhash64 of the text."""
    index = _Index(docs, benchmark, text_col, item_id, item_text, WINDOW)
    order = Window.partitionBy("th", "item").orderBy("at", "q")
    near = index.postings.withColumn("before", F.lag("at").over(order)).withColumn("bq", F.lag("q").over(order))
    near = near.filter((F.col("at") - F.col("before") <= within) & (F.col("q") != F.col("bq")))
    named = near.join(index.small(index.items.select("item", "item_id")), "item")
    return named.select(
        F.col("th").alias("text_hash"), "item_id", F.col("before").alias("first"), F.col("at").alias("last")
    ).distinct()


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return phrase_matches(docs, benchmark).drop("text", "items")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.s, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
