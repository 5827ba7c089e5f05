"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the number of their shingles. An item that shares at least `share` percent of its
q shingles with a document lacks at most q - ceil(share * q / 100) of them, so of any one more than that
at least one is in the document: the item's MinHash sketch is the bottom-k of its shingle hashes with that
k. Documents probe the sketches with the shingles under the largest sketch value; who meets a sketch is
verified by exact shingle containment. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.shared import written

WIDTH = 5
SHARE = 80
#: Sides of at most so many rows (32 bytes each at most) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """Lower-cased words between white space; none for null."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(low, "[\x20\x09-\x0D]+"), lambda w: w != "")


def word_hashes(rows: DataFrame, *keys: str) -> DataFrame:
    """`keys` and w, the hashes of the row's words."""
    return rows.select(*keys, words(F.col("text")).alias("w")).select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))


def shingles(hashed: DataFrame, width: int, *keys: str) -> DataFrame:
    """`keys` and h for each run of `width` words, with `hashed` from word_hashes().

    Runs are zipped from shifted slices, so that only the hash of each word is interpreted and the rest is
    generated code.
    """
    runs = F.greatest(F.size("w") - (width - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("w", k + 1, runs).alias(f"w{k}") for k in range(width)])
    return hashed.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.xxhash64(F.lit(width), *[f"z.w{k}" for k in range(width)]).alias("h"))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, item_key, n, q, h) of the q distinct shingles of each item; one of n < `width` words is one run of its own.

    An item is a text under an id: rows that share an id are items each for itself.
    """
    keyed = items.select("item_id", F.xxhash64("text").alias("item_key"), "text")
    hashed = word_hashes(keyed, "item_id", "item_key").withColumn("n", F.least(F.size("w"), F.lit(width))).filter("n > 0")
    parts = [shingles(hashed.filter(F.col("n") == n), n, "item_id", "item_key", "n") for n in range(1, width + 1)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    every = every.distinct()
    sizes = every.groupBy("item_id", "item_key").agg(F.count("*").alias("q")).withColumnsRenamed({"item_id": "item", "item_key": "key"})
    return every.join(sizes, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("item_key") == F.col("key"))).drop("item", "key")


def _held(docs: DataFrame, items: DataFrame, share: int, width: int) -> DataFrame:
    """(doc_id, text_key, item_id, q, shared) of each text under an id that holds an item, itself a text under an id."""
    wanted = written(item_shingles(items.select("item_id", "text").distinct(), width), "items")
    misses = F.floor((F.lit(100) - share) * F.col("q") / 100)
    sketch = wanted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "item_key").orderBy("h"))).filter(F.col("rank") <= misses + 1)
    # partitions by size: powers of two of q, each with the largest hash of its sketches
    sketch = written(sketch.select("n", "h", F.floor(F.log2("q")).cast("int").alias("band")).distinct(), "sketch")
    tops = sketch.groupBy("n", "band").agg(F.max("h").alias("top")).orderBy("n", F.desc("top"), "band").collect()  # at most 64 * `width` rows
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    widths = sorted({t.n for t in tops})

    def runs(rows: DataFrame) -> list[tuple[int, DataFrame]]:
        hashed = word_hashes(rows, "doc_id", "text_key")
        return [(n, shingles(hashed, n, "doc_id", "text_key")) for n in widths]

    def all_of(parts: list[DataFrame], like: str) -> DataFrame:
        every = docs.sparkSession.createDataFrame([], like) if not parts else parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        return every

    def probes(n: int, rows: DataFrame) -> DataFrame:
        """Each run with the partitions that it may meet: those whose sketches reach up to its hash."""
        own = [t for t in tops if t.n == n]
        reached = F.filter(F.array(*(F.struct(F.lit(t.band).alias("band"), F.lit(t.top).alias("top")) for t in own)), lambda t: t["top"] >= F.col("h"))
        near = rows.filter(F.col("h") <= own[0].top).withColumn("t", F.explode(reached))
        return near.select("doc_id", "text_key", F.lit(n).alias("n"), F.col("t.band").alias("band"), "h")

    met = all_of([probes(n, rows) for n, rows in runs(source)], "doc_id long, text_key long, n int, band int, h long").join(_small(sketch), ["n", "band", "h"], "left_semi")
    suspects = written(met.select("doc_id", "text_key").distinct(), "suspects")
    named = suspects.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    near = source.join(_small(named), F.col("text_key").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    every = all_of([rows for _, rows in runs(near)], "doc_id long, text_key long, h long").distinct()
    shared = every.join(_small(wanted.select("item_id", "item_key", "q", "h")), "h")
    counted = shared.groupBy("doc_id", "text_key", "item_id", "item_key", "q").agg(F.count("*").alias("shared"))
    return counted.filter(F.lit(100) * F.col("shared") >= share * F.col("q"))


def leaks(docs: DataFrame, items: DataFrame, share: int = SHARE, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) of documents that hold `share` percent of an item's shingles.

    Texts without words hold nothing and are in nothing; rows of docs(doc_id, text) that repeat count once,
    rows that share a doc_id or an item_id are compared each for itself; null ids are kept. Of the items of
    one id that a document holds, the figures are those of the largest, of a tie those with most shared.
    Texts of any length are read whole. Other columns are ignored. An empty table on either side gives an
    empty table.
    """
    held = _held(docs, items, share, width).groupBy("doc_id", "item_id").agg(F.max(F.struct("q", "shared")).alias("b"))
    return held.select("doc_id", "item_id", F.col("b.q").cast("int").alias("item_shingles"), F.col("b.shared").alias("shared_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, share: int = SHARE, width: int = WIDTH) -> DataFrame:
    """Rows of `docs`, all columns, whose own text holds no item.

    Each row goes or stays by its text, so rows that share a doc_id, or have none, are judged each for itself;
    repeated rows alike. Null texts and texts without words stay. Column names of `docs` are free.
    """
    taken = {c.lower() for c in docs.columns}
    id_, key = (next(x + "_" * k for k in range(len(taken) + 1) if x + "_" * k not in taken) for x in ("caught_id", "caught_text"))
    caught = written(_held(docs, items, share, width).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "caught")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(key))
    return docs.join(_small(caught), same, "left_anti")


#: An item of under five words is one shingle of as many words.
ORACLE_SQL = r"""
with item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
item_sized as (select item_id, w, least(len(w), 5) as n from item_words where len(w) > 0),
item_shingles as (
  select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) as s from item_sized),
q as (select item_id, count(*) as n_shingles from item_shingles group by item_id),
doc_words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
doc_shingles as (
  select distinct doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) as s
  from doc_words, (select distinct n from item_sized) where len(w) >= n),
hits as (
  select doc_id, item_id, count(*) as shared from doc_shingles join item_shingles using (n, s) group by doc_id, item_id)
select doc_id, item_id, cast(n_shingles as int) as item_shingles, shared as shared_shingles
from hits join q using (item_id) where 100 * shared >= 80 * n_shingles
"""
