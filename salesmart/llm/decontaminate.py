"""Benchmark passages in documents, by a prefix-filtered join. DataFrame functions only.

Every window of an item must be found whole, so each of its shingles is necessary. Shingles
are ordered by how often the documents hold them, and a window is joined on its rarest one,
its prefix. The shingle's place in the window bounds where the window can stand in the
document; a candidate within the document's bounds is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.llm.common import lower_ascii
from salesmart.sources.staging import stage

#: Words: runs of a-z, digits and all characters beyond ASCII, after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: The bit table that documents are probed with: bits per shingle, and bounds of its size.
#: A larger benchmark only lets more shingles through to the join.
BITS_PER_SHINGLE, LEAST_BITS, MOST_BITS = 32, 1 << 14, 1 << 24
#: Windows in one row of the table that candidates are joined with.
WINDOWS_A_ROW = 64

_KEY = ["doc_id", "text_hash"]


def words_of(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle(words: str, start: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), start + i) for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows and the items that hold them; a short item is one window.

    Null texts have no words and so no window; a null item_id is searched for but not listed.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = words.where(F.size("words") > 0).select(
        "item", "words", F.explode(starts).alias("start")).select(
        "item", F.slice("words", F.col("start") + 1, F.lit(window)).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """Shingles of ``size`` words of the windows that have them as their unit of search."""
    length = F.size("window")
    unit = length >= SHINGLE if size == SHINGLE else length == size
    return windows.where(unit).select(
        "window", "items", F.explode(F.sequence(F.lit(0), length - size)).alias("offset")).select(
        "window", "items", "offset", F.lit(size).alias("size"),
        _shingle("window", F.col("offset"), size).alias("shingle"))


def _places(shingle: Column, bits: int) -> list[Column]:
    """Two bit numbers from different ends of a 64-bit hash."""
    return [shingle.bitwiseAND(F.lit(bits - 1)),
            F.shiftrightunsigned(shingle, 64 - (bits.bit_length() - 1))]


def bit_table(shingles: DataFrame, bits: int) -> Column:
    """One array of ``bits / 64`` numbers, with the bits of all shingles set, as a scalar."""
    spark = shingles.sparkSession
    place = shingles.select(F.explode(F.array(*_places(F.col("shingle"), bits))).alias("place"))
    numbers = place.groupBy(F.shiftright("place", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
    # The size is fixed, whatever the tables hold.
    every = spark.range(bits // 64).join(numbers, "id", "left").select(
        "id", F.coalesce("set", F.lit(0)).alias("set"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "set"))).alias("rows")).select(
        F.col("rows.set")).scalar()


def _probably(shingle: Column, table: Column, bits: int) -> Column:
    tests = [
        F.call_function(
            "shiftrightunsigned", F.get(table, F.shiftright(place, 6).cast("int")),
            place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        for place in _places(shingle, bits)]
    return tests[0] & tests[1]


def document_shingles(docs: DataFrame, table: Column, bits: int, size: int, window: int) -> DataFrame:
    """One row per document (place -1), and one per place where a searched shingle may stand.

    Places carry the words around them, as far as a window over the place can reach, so the
    texts are read once and never shuffled.
    """
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    number = F.size("words")
    placed = words.select(
        "*", number.alias("n_words"),
        F.explode_outer(F.sequence(F.lit(-1), number - 1)).alias("place"))
    place = F.col("place")
    shingle = _shingle("words", place, size)
    first = F.greatest(place - (window - size), F.lit(0))
    return placed.where(
        (place < 0) | ((place + size <= F.col("n_words")) & _probably(shingle, table, bits))).select(
        *_KEY, "n_words", "place", F.when(place >= 0, shingle).alias("shingle"),
        first.alias("first"),
        F.when(place >= 0, F.slice("words", first + 1, place + window - first)).alias("around"))


def hits(places: DataFrame, shingles: DataFrame) -> DataFrame:
    """Spans and items found, one row per place of a window's rarest shingle."""
    found = places.where("place >= 0")
    counts = found.groupBy("shingle").agg(F.count("*").alias("frequency"))
    # A shingle that no document holds rules its window out.
    ordered = shingles.join(counts, "shingle", "left").withColumn(
        "frequency", F.coalesce("frequency", F.lit(0)))
    rarest = ordered.groupBy("window").agg(
        F.min(F.struct("frequency", "shingle", "offset")).alias("prefix"),
        F.first("items").alias("items")).where("prefix.frequency > 0").select(
        F.col("prefix.shingle").alias("shingle"), F.col("prefix.offset").alias("offset"),
        "window", "items")
    rows = rarest.groupBy("shingle").agg(F.ceil(F.count("*") / WINDOWS_A_ROW).alias("rows"))
    packed = rarest.join(rows, "shingle").groupBy(
        "shingle", F.pmod(F.xxhash64("window"), "rows").alias("row")).agg(
        F.collect_list(F.struct("offset", "window", "items")).alias("windows")).drop("row")
    place = F.col("place")

    def stands(candidate: Column) -> Column:
        at = place - candidate["offset"]
        length = F.size(candidate["window"])
        inside = (at >= 0) & (at + length <= F.col("n_words"))
        return inside & (F.slice(F.col("around"), F.greatest(at - F.col("first"), F.lit(0)) + 1, length)
                         == candidate["window"])

    matched = found.join(packed, "shingle").select(
        *_KEY, "place", F.filter("windows", stands).alias("windows")).where(F.size("windows") > 0)
    return matched.select(
        *_KEY,
        F.transform("windows", lambda w: F.struct(
            (place - w["offset"]).alias("start"),
            (place - w["offset"] + F.size(w["window"])).alias("end"))).alias("spans"),
        F.array_distinct(F.flatten(F.transform("windows", lambda w: w["items"]))).alias("items"))


def covered(spans: Column) -> Column:
    """How many places a list of (start, end) spans covers."""
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(state: Column, span: Column) -> Column:
        return F.struct(
            F.greatest(state["end"], span["end"]).alias("end"),
            (state["total"] + F.greatest(
                F.lit(0), span["end"] - F.greatest(state["end"], span["start"]))).alias("total"))

    return F.aggregate(F.array_sort(spans), nothing, add)["total"]


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, words hit and items per row of ``docs``.

    A null text has no words. Rows that repeat a doc_id are judged each by its text; null
    doc_ids stay. Columns: doc_id, text_hash, n_words, n_hit, n_items, items_sha256 (of the
    sorted ids, comma-joined; of the empty string without any) and contaminated.
    """
    windows = stage(item_windows(items, window), "windows")
    # At most SHINGLE numbers: the sizes of the units of search.
    sizes = [row[0] for row in windows.select(
        F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]
    found = None
    documents = None
    for size in sorted(sizes, reverse=True):
        shingles = stage(window_shingles(windows, size), "shingles")
        bits = LEAST_BITS
        while bits < MOST_BITS and bits < BITS_PER_SHINGLE * shingles.count():
            bits *= 2
        places = stage(document_shingles(
            docs, bit_table(shingles, bits), bits, size, window), "places")
        if documents is None:
            documents = places
        more = hits(places, shingles)
        found = more if found is None else found.union(more)
    found = stage(found, "hits")
    spans = found.groupBy(*_KEY).agg(covered(F.flatten(F.collect_list("spans"))).alias("n_hit"))
    listed = found.select(*_KEY, F.explode("items").alias("item")).distinct().groupBy(*_KEY).agg(
        F.array_sort(F.collect_list("item")).alias("listed"))
    joined = documents.where("place < 0").select(*_KEY, "n_words")
    for more, name in ((spans, "spans"), (listed, "listed")):
        side = more.select(F.col("doc_id").alias(f"{name}_id"),
                           F.col("text_hash").alias(f"{name}_hash"), more.columns[-1])
        joined = joined.join(side, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (
            F.col("text_hash") == F.col(f"{name}_hash")), "left").drop(f"{name}_id", f"{name}_hash")
    ids = F.coalesce("listed", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        *_KEY, F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``search`` by the columns of its contract."""
    return search(docs, items).drop("text_hash")


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, all columns as they are."""
    hit = stage(search(docs, items).where("contaminated").select(
        F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")), "contaminated")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (
        F.xxhash64("text") == F.col("_hit_hash")), "left_anti")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, words[s + 1 : s + {WINDOW}] AS win
  FROM b, unnest(range(greatest(len(words) - {WINDOW}, 0) + 1)) AS t(s) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, s, n, words[s + 1 : s + n] AS win
  FROM d, sizes, unnest(range(greatest(len(words) - n + 1, 0))) AS t(s)),
found AS (SELECT doc_id, item_id, s, n FROM places JOIN windows USING (win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
