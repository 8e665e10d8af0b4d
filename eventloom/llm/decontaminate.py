"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions alone.

Texts and benchmark items become sequences of forms: words without outer punctuation in lower
case, with typed placeholders for numbers (any word with a digit), units (a unit of measure after
a number) and names (a capitalised word that does not start a sentence). Windows of WINDOW forms
(an item with fewer is one window) are hashed and joined with the benchmark's. A matching window
counts if its slots are consistent: equal values in the item's slots stand for equal values in
the document's, and different ones for different ones, so a question with other numbers and names
is found, while a chance match of placeholders is not. Benchmark windows that are mostly
placeholders match too much and only count with their own values. A window of the same words also
counts, whatever their case, as capitals alone would make names of a whole passage.

Scale: words and forms come from a few passes over whole texts (:func:`canonical`). Documents are read as they lie and never
shuffled to find matches, as long as the benchmark's windows (BROADCAST_WINDOWS at most, counted first) fit in memory
everywhere; a larger benchmark is joined by shuffle. Matching windows are found by shorter grams of words and of forms
at every few places of a document, of which each window holds one; only documents with a gram of the benchmark have all their
windows compared and their slots looked at. Benchmark windows that are mostly placeholders are looked up whole at every place,
as their grams stand in many documents.

Edge cases: a null or empty text or item matches nothing; items with fewer than MIN_FORMS forms are
too short to tell and match nothing; rows that repeat a doc_id and text are judged alike; an empty benchmark
finds nothing and an empty table gives no rows; very long texts are searched whole. Extra columns pass through
:func:`decontaminated`. `min_forms` and `min_literal` are parameters of all functions here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, materialised, plainly_named, text_or_empty

WINDOW = 8
MIN_FORMS = 5
#: Literal forms that a window needs for matches with other values.
MIN_LITERAL = 4
BROADCAST_WINDOWS = 1_000_000
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"

#: Units of measure.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kelvin watt watts volt volts hz kb mb gb"
).split()


_OTHER = r"[^\p{L}\p{N}]"  # a character that no core begins or ends with
_INNER = r"[^\p{L}\p{N}\p{Cs}\x20\x09-\x0D%s]"  # such a one within a word; no half of a surrogate pair
#: What lies between the cores of two words, with the first sentence mark behind the former, unless it is one space; and what leads the text.
_GAPS = rf"(?=[^a-zA-Z])(?! [\p{{L}}\p{{N}}])(?:\A{_OTHER}++|{_INNER % '.!?:;'}*+([.!?:;]?+){_INNER % ''}*+[\x20\x09-\x0D]{_OTHER}*+)"
_ENDS = r"[.!?:;](?= )"


def words(text: str | Column) -> Column:
    """The words of a text that have a letter or digit."""
    return F.filter(F.split(text_or_empty(text), SPACES), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def _marked(line: Column) -> Column:
    """A line of cores, each followed by its sentence mark, if any, and a space, with placeholders, in lower case."""
    named = F.regexp_replace(line, r" (?<![.!?:;] )\p{Lu}[^ \p{N}]*+(?= )", f" {NAME}")
    numbered = F.regexp_replace(named, r"(^| )[^ \p{N}]*+\p{N}[^ ]*+", f"$1{NUMBER}")
    units = F.regexp_replace(F.lower(numbered), rf"({NUMBER} )(?:{'|'.join(UNITS)})(?=[.!?:;]? )", f"$1{UNIT}")
    return F.when(line.rlike(r"\p{N}"), units).otherwise(F.lower(named))


def canonical(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with cores (an entry for each of its :func:`words`, in lower case and without outer punctuation) and forms.

    Both are found in passes over the whole text: an expression for each word would cost several times as much.
    """
    line = df.withColumn("line", F.ltrim(F.regexp_replace(F.concat(text_or_empty(text_col), F.lit(" ")), _GAPS, "$1 ")))
    split = lambda c: F.split(F.regexp_replace(c, _ENDS, ""), " ")
    both = line.withColumn("cores", split(F.lower("line"))).withColumn("forms", split(_marked(F.col("line"))))
    # a line ends with a space, so an empty string comes last
    return both.select(*df.columns, *[F.slice(c, 1, F.size(c) - 1).alias(c) for c in ("cores", "forms")])


def _names(found: Column) -> Column:
    """Each form hashed once, so that windows are hashed from numbers."""
    return F.transform(found, lambda f: F.xxhash64(f))


def slot_pattern(cores: Column, kinds: Column) -> Column:
    """For each slot of a window the place of the first slot with the same value: equal patterns map values one to one."""
    slots = F.transform(cores, lambda w, i: F.when(_is_slot(F.get(kinds, i)), w).otherwise(F.lit("")))
    return F.transform(slots, lambda w: F.when(w == "", F.lit(0).cast("long")).otherwise(F.array_position(slots, w)))


def _is_slot(form: Column) -> Column:
    return form.isin(NUMBER, UNIT, NAME)


def _grams(size: int) -> tuple[int, int]:
    """(length, step): every window of `size` words holds a gram of this length that starts at a multiple of the step."""
    length = size // 2 + 1
    return length, size - length + 1


def _starts(kind: str, size: int, step: int = 1) -> Column:
    last = F.size(kind) - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _grams_at(kind: str, length: int, step: int) -> Column:
    return F.transform(_starts(kind, length, step), lambda i: F.xxhash64(F.slice(kind, i, F.lit(length))))


def _windows_at(kind: str, size: int) -> Column:
    return F.transform(_starts(kind, size), lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(F.slice(kind, i, F.lit(size))).alias("h")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", min_forms: int = MIN_FORMS) -> DataFrame:
    """item_id, size, start, cores and forms of the window, h (the hash of its forms), literal, pattern, exact (the hash of its lower-cased words), plain (the hash of its cores)."""
    items = canonical(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "text").withColumn("words", words("text")).where(F.size("words") >= min_forms)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    rows = items.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    cut = rows.select("item_id", "size", "start", *[F.slice(c, F.col("start"), F.col("size")).alias(c) for c in ("words", "cores", "forms")])
    return cut.select(
        "item_id",
        "size",
        "start",
        "cores",
        "forms",
        F.xxhash64(_names(F.col("forms"))).alias("h"),
        F.size(F.filter("forms", lambda x: ~_is_slot(x))).alias("literal"),
        slot_pattern(F.col("cores"), F.col("forms")).alias("pattern"),
        F.xxhash64(F.transform("words", F.lower)).alias("exact"),
        F.xxhash64(_names(F.col("cores"))).alias("plain"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_forms: int = MIN_FORMS, min_literal: int = MIN_LITERAL) -> DataFrame:
    """id, body (a hash of the text), item_id, n_windows: the items of which a document holds windows with consistent slots."""
    wanted = materialised(benchmark_windows(benchmark, window, item_col, item_text, min_forms))
    enough = F.col("literal") >= min_literal
    found = wanted.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("size", enough.alias("enough"))).alias("kinds")).first()  # at most two for each size
    light = lambda f: F.broadcast(f) if found["n"] <= BROADCAST_WINDOWS else f.hint("merge")
    if not found["kinds"]:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("body"), F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    kinds = sorted(found["kinds"])
    sizes = sorted({k["size"] for k in kinds})
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("body"), F.col(text_col).alias("text"))
    of_text = lambda hits: [F.col("id").eqNullSafe(hits["__id"]), F.col("body") == hits["__body"]]
    keyed = [F.col("id").alias("__id"), F.col("body").alias("__body")]
    # documents that hold a gram of the benchmark; grams of windows that are mostly placeholders stand everywhere, so those are looked up whole
    grams = [(F.col("size") == s, "cores", *_grams(s)) for s in sizes]
    grams += [((F.col("size") == k["size"]) & (enough == F.lit(k["enough"])), "forms", *(_grams(k["size"]) if k["enough"] else (k["size"], 1))) for k in kinds]
    held = [wanted.where(of).select(F.explode(F.array(*[F.xxhash64(F.slice(kind, i + 1, length)) for i in range(step)])).alias("gram")) for of, kind, length, step in grams]
    keys = reduce(DataFrame.unionByName, held).distinct()
    ways = sorted({(kind, length, step) for _, kind, length, step in grams})
    places = F.concat(*[_grams_at(*way) for way in ways])
    hits = canonical(read, "text").select("id", "body", F.explode(places).alias("gram")).join(light(keys), "gram", "left_semi").select(*keyed).distinct()
    looked = read.join(hits, of_text(hits)).select("id", "body", "text").dropDuplicates(["id", "body"])
    looked = materialised(canonical(looked, "text").withColumn("words", words("text")).drop("text"))

    def windows(kind: str) -> DataFrame:
        names = looked.select("id", "body", _names(F.col(kind)).alias(kind))
        return names.select("id", "body", F.explode(F.concat(*[_windows_at(kind, s) for s in sizes])).alias("x")).select("id", "body", "x.*")

    equal = windows("cores").join(light(wanted.select("item_id", "start", "size", F.col("plain").alias("h"))), ["h", "size"]).select("id", "body", "item_id", "start")
    hits = windows("forms").join(light(wanted.select("h", "size").distinct()), ["h", "size"], "left_semi").groupBy("id", "body").agg(F.collect_set(F.struct("size", "at", "h")).alias("hits")).select(*keyed, "hits")
    slotted = looked.join(hits, of_text(hits)).select("id", "body", "words", "cores", "forms", "hits")
    cut = lambda c, x: F.slice(c, x["at"], x["size"])
    slots = F.transform("hits", lambda x: F.struct(x["size"].alias("size"), x["h"].alias("h"), slot_pattern(cut("cores", x), cut("forms", x)).alias("has"), F.xxhash64(F.transform(cut("words", x), F.lower)).alias("is")))
    checked = slotted.select("id", "body", F.explode(slots).alias("x")).select("id", "body", "x.*").join(light(wanted.drop("cores", "forms", "plain")), ["h", "size"])
    consistent = (F.col("has") == F.col("pattern")) & (enough | (F.col("is") == F.col("exact")))
    return checked.where(consistent).select("id", "body", "item_id", "start").unionByName(equal).groupBy("id", "body", "item_id").agg(F.countDistinct("start").alias("n_windows"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with contaminated, n_items and item_ids; input columns of these names are replaced."""
    docs, names = plainly_named(docs, ("contaminated", "n_items", "item_ids"))
    id_col, text_col = names[id_col], names[text_col]
    items = matches(docs, benchmark, window, id_col, text_col, **options).groupBy("id", "body").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.col("id").alias("__id"), F.col("body").alias("__same"), "item_ids")
    keyed = docs.withColumn("__body", F.xxhash64(F.col(text_col)))
    joined = keyed.join(items, keyed[id_col].eqNullSafe(items["__id"]) & (keyed["__body"] == items["__same"]), "left")
    none = F.array().cast(items.schema["item_ids"].dataType)
    return joined.select(*[keyed[c] for c in docs.columns], F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids")).withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long"))).toDF(*names, "contaminated", "n_items", "item_ids")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark passage, with their columns."""
    docs, names = plainly_named(docs)
    return contamination(docs, benchmark, window, names[id_col], names[text_col], **options).where("not contaminated").select(*docs.columns).toDF(*names)
