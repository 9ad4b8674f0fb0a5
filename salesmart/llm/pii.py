"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Seeds are the matches of strict patterns. The words before them induce contexts. Rounds score
a graph of contexts and identifiers: a context is trusted for a kind if its known members of
the kind far outnumber what speaks against it, known members of other kinds and identifiers
without the loose form of the kind. Identifiers of that form that are not known yet count
neither way. They become members wherever they stand, and what is found that way counts in
the next round, until a round finds nothing new.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from salesmart.sources.staging import stage


class Kind(NamedTuple):
    """hint: what any text with a match contains; pattern: the strict form; loose: the form
    that a member found by its context must have."""
    name: str
    hint: str
    pattern: str
    loose: str


# Patterns start only where a match can start (not inside a run that was tried from its
# beginning), so that long runs of one class take linear time.
KINDS = [
    Kind("email", "@",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"^[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9.-]+$"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
         r"^(?:[0-9]{1,3}(?:[.,][0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})$"),
    Kind("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", r"^[0-9][0-9-]{11,22}[0-9]$"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"^\(?[0-9][0-9().-]{5,16}[0-9]$"),
]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word with a digit, an at sign or a spelled one: what a context may reveal as a member.
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@](?:\S*[A-Za-z0-9])?"
#: Characters before an identifier in which its context, the last two words, is looked for.
REACH = 60
#: A trusted context holds so many different members, in so many different documents, and
#: members are so large a share of them and of the identifiers that speak against the kind.
SUPPORT, DOCUMENTS, TRUST = 5, 5, 0.9
#: Binary logarithm of the size of the sketches that count documents; few are counted exactly.
SKETCH = 8
#: Sums over arrays run in parts of this size, so that long arrays take linear time.
PART = 256
#: Characters of the blocks in which places of a text are looked up; more than REACH.
BLOCK = 1024

_SPAN = "struct<kind: int, start: int, end: int>"
_KEY = ["doc_id", "text_hash"]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there, in loops too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK code points: a place is found in its block, not from the start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, out of the blocks that hold it."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    return F.when(end <= start, "").otherwise(F.substr(
        F.array_join(F.slice(blocks, first + 1, F.greatest(count, F.lit(1))), ""),
        (start - first * BLOCK + 1).cast("int"), (end - start).cast("int")))


def _sums_before(values: Column) -> Column:
    """struct(total, before) of an array: its sum, and the sum before every element."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(values, start, lambda state, value: F.struct(
        (state["total"] + value).alias("total"),
        F.concat(state["before"], F.array(state["total"])).alias("before")))


def sums_before(values: Column) -> Column:
    """The sum before every element of an array of any length."""
    return once(F.transform(parts_of(values), _sums_before), lambda parts: F.flatten(F.zip_with(
        parts, _sums_before(F.transform(parts, lambda part: part["total"]))["before"],
        lambda part, base: F.transform(part["before"], lambda value: value + base))))


def parts_of(values: Column) -> Column:
    """An array in parts of PART elements; one empty part if it has none."""
    return once(values, lambda array: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / PART).cast("int") - 1, F.lit(0))),
        lambda part: F.slice(array, part * PART + 1, F.lit(PART))))


def counts_before(places: Column, queries: Column, inclusive: bool) -> Column:
    """For every query, in order, how many places are smaller (or as large, if ``inclusive``).

    Both are sorted into one array, over which places are counted: no query looks at all places.
    """
    # Of equal numbers the even one comes first.
    mark = int(inclusive)
    every = F.array_sort(F.concat(
        F.transform(places, lambda place: place.cast("bigint") * 2 + (1 - mark)),
        F.transform(queries, lambda query: query.cast("bigint") * 2 + mark)))
    return once(every, lambda events: F.array_compact(F.zip_with(
        events, sums_before(F.transform(events, lambda event: F.when(event % 2 == mark, 0).otherwise(1))),
        lambda event, count: F.when(event % 2 == mark, count))))


def located(df: DataFrame, pattern: str, hint: str, out: str) -> DataFrame:
    """Add ``out``: the matches of a pattern in ``text`` as (start, end, value) by code points."""
    none = F.array().cast("array<string>")
    has = F.col("text").rlike(hint)
    found = df.select(
        "*", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        .alias("_matches"))
    gaps = F.when(F.size("_matches") > 0, F.split("text", pattern, -1)).otherwise(none)
    steps = found.select("*", F.zip_with(
        F.slice(gaps, 1, F.size("_matches")), "_matches",
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("length"),
                                    match.alias("value"))).alias("_steps"))
    starts = steps.select("*", sums_before(F.transform(
        "_steps", lambda step: step["gap"] + step["length"])).alias("_before"))
    return starts.select("*", F.zip_with("_steps", "_before", lambda step, before: F.struct(
        (before + step["gap"]).alias("start"),
        (before + step["gap"] + step["length"]).alias("end"),
        step["value"].alias("value"))).alias(out)).drop("_matches", "_steps", "_before")


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _context(start: Column) -> Column:
    """The last two words before a place, lower-cased; null without letters in them."""
    before = between(F.col("blocks"), F.greatest(start - REACH, F.lit(0)), start)
    words = F.regexp_extract(F.lower(before), r"(?:^|\s)(\S+\s+\S+)\s+$", 1)
    return F.when(words.rlike(r"\p{L}.*\s.*\p{L}"), F.regexp_replace(words, r"\s+", " "))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, seeds and candidates of every document, texts left behind.

    Seeds are the strict matches (kind, start, end, value, context); candidates are the other
    identifiers, outside of all seeds.
    """
    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        found = located(found, kind.pattern, kind.hint, kind.name)
    found = located(found, IDENTIFIER, "[0-9@]", "identifiers")

    def member(number: Column, match: Column) -> Column:
        return F.struct(
            number.alias("kind"), match["start"].alias("start"), match["end"].alias("end"),
            match["value"].alias("value"), _context(match["start"]).alias("context"))

    def members(number: int, kind: str) -> Column:
        return F.transform(F.filter(kind, lambda match: _holds(kind, match["value"])),
                           lambda match: member(F.lit(number), match))

    seeds = F.concat(*[members(number, kind.name) for number, kind in enumerate(KINDS)])
    any_match = F.lit(False)
    for name in ("identifiers", *(kind.name for kind in KINDS)):
        any_match = any_match | (F.size(name) > 0)
    blocked = found.select("*", F.when(any_match, blocks_of(F.col("text"))).otherwise(
        F.array().cast("array<string>")).alias("blocks"))
    seeded = blocked.select(*_KEY, "blocks", "identifiers", seeds.alias("seeds"))
    # A word meets as many seeds as start before its end, less those that end before its start.
    begun = counts_before(F.col("seeds.start"), F.col("identifiers.end"), False)
    over = counts_before(F.col("seeds.end"), F.col("identifiers.start"), True)
    free = F.array_compact(F.zip_with(
        "identifiers", F.zip_with(begun, over, lambda some, less: some == less),
        lambda word, is_free: F.when(is_free, word)))
    return seeded.select(
        *_KEY, "seeds",
        F.transform(free, lambda word: member(F.lit(-1), word)).alias("candidates"))


def discover(found: DataFrame) -> DataFrame:
    """(kind, value) of the candidates that trusted contexts show to be members of a kind."""
    seeds = found.select(*_KEY, F.explode("seeds").alias("m")).select(*_KEY, "m.*")
    words = found.select(*_KEY, F.explode("candidates").alias("m")).select(*_KEY, "m.*")
    forms = F.array(*[F.when(F.col("value").rlike(kind.loose), F.lit(number))
                      for number, kind in enumerate(KINDS)])
    # One row per context and value, with a sketch of the documents it stands in.
    mentions = stage(
        seeds.union(words).where("context IS NOT NULL").groupBy("context", "value", "kind").agg(
            F.hll_sketch_agg("text_hash", F.lit(SKETCH)).alias("documents")), "mentions")
    possible = mentions.where("kind < 0").select(
        "context", "value", F.explode(F.array_compact(forms)).alias("kind"))
    every = mentions.groupBy("context").agg(F.count_distinct("value").alias("all"))
    learned, size = None, 0
    # The members only grow and are identifiers of the texts, so this ends.
    while True:
        known = mentions.where("kind >= 0")
        if learned is not None:
            known = known.union(mentions.where("kind < 0").drop("kind").join(
                learned, "value").select(*mentions.columns))
        rich = known.groupBy("context", "kind").agg(
            F.count_distinct("value").alias("members"),
            F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("documents")).where(
            (F.col("members") >= SUPPORT) & (F.col("documents") >= DOCUMENTS))
        undecided = possible.join(rich.select("context", "kind"), ["context", "kind"]).join(
            known.select("context", "value"), ["context", "value"], "left_anti").groupBy(
            "context", "kind").agg(F.count("*").alias("undecided"))
        decided = F.col("all") - F.coalesce("undecided", F.lit(0))
        trusted = rich.join(every, "context").join(
            undecided, ["context", "kind"], "left").where(
            F.col("members") >= TRUST * decided).select("context", "kind")
        now = possible.join(trusted, ["context", "kind"]).select("kind", "value")
        if learned is not None:
            now = now.union(learned)
        learned = stage(now.distinct(), "members")
        before, size = size, learned.count()
        if size == before:
            return learned


def _spans_of(found: DataFrame, members: DataFrame) -> DataFrame:
    """The spans of discovered members per document."""
    words = found.select(*_KEY, F.explode("candidates").alias("m")).select(*_KEY, "m.*").drop("kind")
    return words.join(members, "value").groupBy(*_KEY).agg(F.collect_set(
        F.struct("kind", "start", "end").cast(_SPAN)).alias("added"))


def _text_of(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda span: F.concat_ws(
        ":", F.get(names, span["kind"]), span["start"], span["end"])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and all spans (kind number, start, end) of every document.

    Null and empty texts have none. Rows that repeat a doc_id are judged each by its text,
    null doc_ids too. Other columns of ``docs`` are ignored.
    """
    found = stage(base_spans(docs), "personal-data")
    added = _spans_of(found, discover(found)).select(
        F.col("doc_id").alias("added_id"), F.col("text_hash").alias("added_hash"), "added")
    base = F.transform("seeds", lambda seed: F.struct(
        seed["kind"].alias("kind"), seed["start"].alias("start"), seed["end"].alias("end")).cast(_SPAN))
    none = F.array().cast(f"array<{_SPAN}>")
    return found.select(*_KEY, base.alias("base")).join(
        added, F.col("doc_id").eqNullSafe(F.col("added_id"))
        & (F.col("text_hash") == F.col("added_hash")), "left").select(
        *_KEY, "base", F.concat("base", F.coalesce("added", none)).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, per row of ``docs``."""
    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == number)).cast("bigint")

    counts = [count(number).alias(f"n_{kind.name}") for number, kind in enumerate(KINDS)]
    return find(docs).select(
        "doc_id", *counts, F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, all columns kept.

    Of spans that overlap, those that start earlier (of these the longest) are replaced.
    """
    found = find(docs).where(F.size("spans") > 0).dropDuplicates(_KEY)
    spans = found.select(
        F.col("doc_id").alias("_span_id"), F.col("text_hash").alias("_span_hash"),
        F.array_sort(F.transform("spans", lambda span: F.struct(
            span["start"].alias("start"), (-span["end"]).alias("back"),
            span["kind"].alias("kind")))).alias("_spans"))
    cut = "array<struct<from: int, start: int, kind: int>>"

    def keep(state: Column, span: Column) -> Column:
        """A span that starts where the last one kept has ended is cut out."""
        return F.when(span["start"] >= state["end"], F.struct(
            (-span["back"]).alias("end"), F.concat(state["cuts"], F.array(F.struct(
                state["end"].alias("from"), span["start"].alias("start"),
                span["kind"].alias("kind")))).alias("cuts"))).otherwise(state)

    def keep_part(state: Column, part: Column) -> Column:
        done = F.aggregate(
            part, F.struct(state["end"].alias("end"), F.array().cast(cut).alias("cuts")), keep)
        return F.struct(done["end"].alias("end"),
                        F.concat(state["cuts"], F.array(done["cuts"])).alias("cuts"))

    labels = F.array(*[F.lit(f"[{kind.name.upper()}]") for kind in KINDS])
    kept = F.aggregate(
        parts_of(F.col("_spans")),
        F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{cut}>").alias("cuts")), keep_part,
        lambda state: F.struct(state["end"].alias("end"), F.flatten(state["cuts"]).alias("cuts")))
    pieces = F.transform("_kept.cuts", lambda one: F.concat(
        between(F.col("_blocks"), one["from"], one["start"]), F.get(labels, one["kind"])))
    rest = between(F.col("_blocks"), F.col("_kept.end"), F.length("text"))
    clean = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(pieces, ""), rest))
    marked = spans.select("_span_id", "_span_hash", kept.alias("_kept"))
    joined = docs.join(marked, F.col("doc_id").eqNullSafe(F.col("_span_id")) & (
        F.xxhash64("text") == F.col("_span_hash")), "left")
    blocked = joined.withColumn("_blocks", F.when(F.col("_kept").isNotNull(), blocks_of(F.col("text"))))
    return blocked.withColumn("text", clean).select(*docs.columns)
