"""Near duplicates by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its word shingles (``SHINGLE`` words; a shorter text is one
shingle); words are runs of ASCII letters, digits and non-ASCII characters with A-Z folded.
Two texts are near duplicates if the weighted Jaccard of the multisets is ``SIMILARITY`` or
more; a class is a connected component of that relation, named by its least id.

* A shingle of count w covers the weight levels 0..w-1. Levels are grouped in dyadic
  intervals [0,1), [1,2), [2,4), [4,8)...; each has one Poisson process of points (time,
  level, signature place), generated in order of time and thinned to levels below w. A
  signature keeps the first point of each place, so equal levels of equal shingles agree in
  any text and the share of equal places estimates the weighted Jaccard without bias. A text
  stops as soon as no process can still beat its worst place.
* Equal word sequences (64-bit hash and length) are one text from then on; copies join
  again by that key at the end.
* Every band of ``ROWS`` places is a key. All members of a key are compared with the least
  of them. Where members of a key are then in different components, those outside the
  largest meet further members of it for some rounds. What is apart after that is compared
  where rare shingles meet: texts of the wanted overlap share one of their rarest fifth, and
  the first one shared stands so early that enough others can follow in both. A key's
  members are pre-aggregated, never collected; joins read written tables on both sides, so
  that Spark splits hot keys.
* Verification computes the weighted Jaccard of the whole multisets.

Texts without a word (null, empty) are in no class but their own. Rows with a null id get a
null class. Rows with equal ids are one document. Extra columns pass through; columns named
as a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import LETTERED, LOWER, SpanHashes, mixed, slices, stored, utf8, without, words

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 32
#: Times that members apart from the largest component of a key meet one more of it.
ROUNDS = 3
_PLACES = ROWS * BANDS
#: Rows of keys, pairs and labels that one task writes.
TASK_ROWS = 1 << 18


def shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text row and count of the distinct shingles, ordered by row; words per row."""
    data, starts = utf8(column)
    n = len(starts) - 1
    data = LOWER[data]
    begin, end, row = words(data, starts, LETTERED)
    size = np.bincount(row, minlength=n)
    word = SpanHashes(data).spans(begin, end)
    if len(word) >= SHINGLE:
        h = np.zeros(len(word) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(h)]
        full = np.flatnonzero(row[SHINGLE - 1 :] == row[: len(h)])
        h, owner = h[full], row[full]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):  # all words of a short text are its one shingle
        at = np.searchsorted(row, short)
        one = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            there = k < size[short]
            one[there] = one[there] * np.uint64(0x9E3779B97F4A7C15) + word[at[there] + k]
        h, owner = np.concatenate([h, one ^ np.uint64(1)]), np.concatenate([owner, short])
    h = mixed(h)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(h)]]))
    # the sequence of words, for exact copies
    place = np.arange(len(word)) - np.searchsorted(row, row)
    sums = mixed(word + mixed(place.astype(np.uint64) + np.uint64(7)))
    key = np.zeros(n, np.uint64)
    np.add.at(key, row, sums)
    return h[first], owner[first], count, np.where(size > 0, mixed(key + size.astype(np.uint64)), 0)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hash to (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def bag_signatures(h: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, places: int = _PLACES) -> np.ndarray:
    """Signatures (n x places) of texts given as distinct shingles with counts."""
    first = np.full(n * places, np.inf)
    label = np.zeros(n * places, np.uint64)
    worst = np.full(n, np.inf)
    low, k = 0, 0
    while len(h) and low < count.max():  # dyadic intervals of weight levels
        width = max(1, low)
        has = np.flatnonzero(count > low)
        of, top = owner[has], count[has]
        state = mixed(h[has] + np.uint64(0x51ED2701 * (k + 1)))
        time = np.zeros(len(has))
        while len(state):  # the next point of every process that can still beat a place
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            time -= np.log(_unit(state)) / width
            live = np.flatnonzero(time < worst[of])
            state, time, of, top = state[live], time[live], of[live], top[live]
            point = mixed(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            at = of * places + ((point >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
            t, p = time, point
            if width > 1:
                level = low + ((point & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
                under = level < top
                at, t, p = at[under], t[under], p[under]
            np.minimum.at(first, at, t)
            won = t == first[at]
            label[at[won]] = p[won]
            seen = slice(None) if len(state) > n // 8 else np.unique(of)
            worst[seen] = first.reshape(n, places)[seen].max(1)
        low, k = low + width, k + 1
    return label.reshape(n, places)


def _sketches(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            h, owner, count, key = shingles(batch.column("text"))
            n = len(key)
            bands = np.zeros((n, BANDS), np.uint64)
            signature = bag_signatures(h, owner, count, n)
            for b in range(BANDS):
                for r in range(ROWS):
                    bands[:, b] = mixed(bands[:, b] * np.uint64(31) + signature[:, b * ROWS + r] + np.uint64(b + 1))
            total = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
            keep = np.flatnonzero(key)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(keep)),
                    pa.array(key[keep].view(np.int64)),
                    pa.array(total[keep]),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BANDS),
                        pa.array(bands[keep].view(np.int64).ravel()),
                    ),
                ],
                names=["id", "copy", "size", "bands"],
            )


def _bags(batches):
    """The distinct shingles as 32-bit hashes in order; counts only where one is not 1."""
    for whole in batches:
        for batch in slices(whole, "text"):
            h, owner, count, key = shingles(batch.column("text"))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            hashes, counts = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                n = count[a:b]
                hashes.append((h[a:b] >> np.uint64(32)).astype(np.uint32).tobytes())
                counts.append(n.astype(np.int32).tobytes() if (n > 1).any() else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())],
                names=["copy", "h", "n"],
            )


def _elements(batches):
    """The members of a bag, equal ones numbered: 32 bits of hash, 31 of number."""
    for batch in batches:
        copies, members = [], []
        for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True):
            h, n = _bag(h, n)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            members.append((np.repeat(h, n).astype(np.int64) << 31) | number)
            copies.append(len(number))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("copy").take(pa.array(np.repeat(np.arange(len(copies)), copies))),
                pa.array(np.concatenate(members) if members else np.zeros(0, np.int64)),
            ],
            names=["copy", "e"],
        )


def overlap(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard of two bags with hashes in order."""
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    both = int(np.minimum(na[same], nb[at[same]]).sum())
    return both / (int(na.sum()) + int(nb.sum()) - both)


def _bag(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(h, np.uint32)
    return h, np.frombuffer(n, np.int32) if n else np.ones(len(h), np.int32)


def _verify(batches):
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("ha", "na", "hb", "nb"))
        values = [overlap(*_bag(ha, na), *_bag(hb, nb)) for ha, na, hb, nb in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(values, pa.float64())], names=["a", "b", "sim"]
        )


def _similarities(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Similarity of each pair of texts (a, b)."""
    left = bags.select(F.col("copy").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    right = bags.select(F.col("copy").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "na", "hb", "nb")
    return joined.mapInArrow(_verify, "a long, b long, sim double")


def _narrow(df: DataFrame, label: str, rows: int) -> DataFrame:
    """``stored`` for at most ``rows`` rows of a few numbers, by no more tasks than they need.

    A file per shuffle partition costs more than its rows where a table is small, and each
    later stage would read all of them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return stored(df.coalesce(tasks), label)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Least id of the component of every linked id: (id, class_id).

    Every round moves each label to the least label among the neighbours' and then to that
    label's own label; rounds end when nothing changes, each is a written table.
    """
    ends = 2 * links.count()
    edges = _narrow(
        links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        .distinct(),
        label,
        ends,
    )
    least = edges.groupBy(F.col("x").alias("id")).agg(F.least("id", F.min("y")).alias("class_id"))
    labels = _narrow(least, label, ends)
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("y"), "class_id"), "y")
            .groupBy(F.col("x").alias("id"))
            .agg(F.min("class_id").alias("near"))
        )
        moved = labels.join(near, "id").select("id", F.least("class_id", "near").alias("to"), F.col("class_id").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("class_id").alias("further"))
        moved = moved.join(jump, "to").select("id", F.least("to", "further").alias("class_id"), "was")
        moved = _narrow(moved, label, ends)
        labels = moved.select("id", "class_id")
        if not moved.filter(F.col("class_id") != F.col("was")).limit(1).count():
            return labels


def merged(labels: DataFrame, new: DataFrame, label: str = "components") -> DataFrame:
    """The labels of ``components`` after the stored links ``new``: only their components are labelled again."""
    n = 2 * new.count()
    ends = new.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left")
    ends = _narrow(ends.select("id", F.coalesce("class_id", "id").alias("class_id")), label, n)
    joined = new.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b")
    joined = _narrow(joined.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), label, n)
    onto = components(joined, label).toDF("class_id", "least")
    known = labels.unionByName(ends).distinct().join(onto, "class_id", "left")
    known = known.select("id", F.coalesce("least", "class_id").alias("class_id"))
    return _narrow(known, label, labels.count() + n)


def near_classes(
    docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY
) -> DataFrame:
    """Every id that has a word: ``id, rep`` (least id of an equal text), ``class_id`` and
    ``n_links``, those links of its text to different texts that were tested to build the
    classes; pairs inside a class that need no test are not counted."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.filter(F.col("id").isNotNull())
    rows = stored(
        texts.mapInArrow(_sketches, "id long, copy long, size long, bands array<long>"), "sketches"
    )
    one = stored(
        rows.groupBy("copy").agg(
            F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")
        ),
        "texts",
    )
    keys = one.select("copy", "size", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min(F.struct("copy", "size")).alias("pivot"), F.count("*").alias("n"))
    n_texts = one.count()
    n_keys = BANDS * n_texts
    full = _narrow(full.filter("n > 1").select("key", "pivot"), "keys", n_keys)
    members = _narrow(keys.join(full, "key"), "members", n_keys)
    n_members = members.count()

    def fits(a, b):
        return F.least(a, b) >= similarity * F.greatest(a, b)

    apart = (F.col("copy") != F.col("pivot.copy")) & fits(F.col("size"), F.col("pivot.size"))
    pairs = members.filter(apart).select(F.col("copy").alias("a"), F.col("pivot.copy").alias("b"))
    pairs = _narrow(pairs.distinct(), "pairs", n_members)
    wanted = one.join(members.select("copy").distinct(), "copy", "left_semi").select(F.col("rep").alias("id"))
    bags = texts.join(wanted, "id", "left_semi").mapInArrow(_bags, "copy long, h binary, n binary")
    bags = stored(bags, "bags")
    tested = _similarities(pairs, bags).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    tested = _narrow(tested, "tested", n_members)
    links = tested.filter(F.col("sim") >= similarity).select("a", "b")
    labels = components(links)

    def still_apart(labels: DataFrame) -> DataFrame:
        """Members, with their components, of the keys that hold more than one."""
        own = members.join(labels.withColumnRenamed("id", "copy"), "copy", "left").select(
            "key", "copy", "size", F.col("pivot.copy").alias("pivot"), F.coalesce("class_id", "copy").alias("class_id")
        )
        own = _narrow(own, "own", n_members)
        split = own.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"))
        split = _narrow(split.filter("lo < hi").select("key"), "split", n_members)
        return _narrow(own.join(split, "key"), "apart", n_members)

    def untested(found: DataFrame) -> DataFrame:
        ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return ordered.join(seen, ["a", "b"], "left_anti")

    seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for again in range(ROUNDS):
        # in each such key, one more member of its largest component meets those outside it
        own = still_apart(labels)
        crowd = own.groupBy("key", "class_id").agg(
            F.count("*").alias("n"), F.min(F.struct(F.xxhash64("copy", "key", F.lit(again)), "copy", "size")).alias("p")
        )
        most = crowd.groupBy("key").agg(F.max(F.struct("n", "class_id", "p")).alias("m"))
        most = most.select("key", F.col("m.class_id").alias("within"), "m.p.copy", "m.p.size").toDF("key", "within", "other", "other_size")
        most = _narrow(most, "most", n_members)
        met = own.join(most, "key").filter((F.col("class_id") != F.col("within")) & fits(F.col("size"), F.col("other_size")))
        met = untested(met.select(F.col("copy").alias("a"), F.col("other").alias("b")))
        fresh = _similarities(_narrow(met, "pairs", n_members), bags)
        fresh = _narrow(fresh.groupBy("a", "b").agg(F.max("sim").alias("sim")), "tested", n_members)
        seen = _narrow(seen.unionByName(fresh.select("a", "b")), "seen", (again + 2) * n_members)
        new = _narrow(fresh.filter(F.col("sim") >= similarity).select("a", "b"), "new", n_members)
        if not new.limit(1).count():
            break
        links = _narrow(links.unionByName(new), "links", (again + 2) * n_members)
        labels = merged(labels, new)

    # what is apart now meets by its rarest shingles, which misses no pair
    left = _narrow(still_apart(labels).select("copy", "size", "class_id").distinct(), "left", n_members)
    single = bags.join(left.select("copy"), "copy", "left_semi").mapInArrow(_elements, "copy long, e long").distinct()
    single = stored(single, "elements")
    n_elements = single.count()
    rarity = _narrow(single.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1"), "rarity", n_elements)
    ranked = single.join(rarity, "e", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("copy").orderBy("df", "e"))
    prefix = ranked.withColumn("place", place).join(left, "copy").filter(
        (F.col("df") > 1) & (F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)
    )
    prefix = _narrow(prefix.select("e", "copy", "size", "class_id", "place"), "prefix", n_elements)
    x, y = prefix.alias("x"), prefix.alias("y")
    # where the first shared shingle stands bounds what can still be shared from there on
    most_shared = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1
    shared = similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-9
    rest = x.join(
        y,
        (F.col("x.e") == F.col("y.e"))
        & (F.col("x.copy") < F.col("y.copy"))
        & (F.col("x.class_id") != F.col("y.class_id"))
        & fits(F.col("x.size"), F.col("y.size"))
        & (most_shared >= shared),
    )
    rest = stored(untested(rest.select(F.col("x.copy").alias("a"), F.col("y.copy").alias("b"))), "pairs")
    more = stored(_similarities(rest, bags).filter(F.col("sim") >= similarity).select("a", "b").distinct(), "new")
    links = stored(links.unionByName(more).distinct(), "links")
    labels = merged(labels, more)
    degree = links.select(F.explode(F.array("a", "b")).alias("copy")).groupBy("copy").agg(F.count("*").alias("n_links"))
    named = one.select("copy", "rep").join(labels.withColumnRenamed("id", "copy"), "copy", "left")
    named = named.join(degree, "copy", "left").withColumn("label", F.coalesce("class_id", "copy"))
    least = _narrow(named.groupBy("label").agg(F.min("rep").alias("class_id")), "classes", n_texts)
    named = _narrow(named.drop("class_id"), "named", n_texts)
    named = _narrow(named.join(least, "label").select("copy", "rep", "class_id", "n_links"), "named", n_texts)
    found = rows.select("id", "copy").join(named, "copy")
    return found.groupBy("id").agg(
        F.min("rep").alias("rep"), F.min("class_id").alias("class_id"), F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links")
    )


def with_classes(docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with ``class_id`` and ``n_links``; a text without words is its own."""
    docs = without(docs, "class_id", "n_links")
    found = near_classes(docs, id_col, text_col, similarity).select(
        F.col("id").alias("__id"), F.col("class_id").alias("__class"), F.col("n_links").alias("__links")
    )
    joined = docs.join(found, docs[id_col].cast("long") == F.col("__id"), "left")
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.coalesce("__class", docs[id_col].cast("long")).alias("class_id"),
        F.coalesce("__links", F.lit(0)).alias("n_links"),
    )


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Class of every document and number of tested links that built it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_classes(docs).select("doc_id", "class_id", "n_links")
