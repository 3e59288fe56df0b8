"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, units after numbers and names inside sentences become the typed
placeholders ``0d``, ``0u`` and ``0n``. Marking works on whole texts, so that no expression runs once a
word but a window's hash. Windows of five canonical tokens are hash-joined between documents
and benchmark items. A document leaks an item if at least 0.8 of the item's windows are found in it,
counting only windows whose slots are consistent: along one alignment of the item with the document
(a diagonal), each value of the item is bound to the value that stands for it most often, and windows
that hold another are not counted, unless they equal the item's. So a
question asked again with other numbers or names is caught, and texts that only share a shape are not.

Everything is a DataFrame expression. The item windows are broadcast up to a counted bound and else
joined by shuffle, where windows without slots, which are nearly all, carry a hash and a place but no tokens.

Defined results: a null text has no windows and leaks nothing; a null item text, or one of fewer than
five tokens or without a window of three literal tokens, cannot be leaked; in `leaks`, rows that
repeat a doc_id are judged as one document, in `decontaminated` each row alone; an empty table on either side gives an empty table;
texts are read whole; a coverage that ties with the threshold is a leak; other columns, whatever their names, are not looked at or stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import ROW, let, numbered, small_side, without_ids
from learntrace.session import stored

WINDOW = 5
COVERAGE = 0.8
LITERALS = 3  # literal tokens that a window of an item needs
ITEM_ROWS = 50_000  # item windows up to which they are broadcast; with their tokens they take some 250 bytes each
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l litre litres liter liters gallon gallons "
    "ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years k hz khz mhz ghz w kw watt watts v volt volts j joule joules n pa bar percent "
    "dollar dollars euro euros usd eur gbp cent cents kmh mph degree degrees"
).split()


def marked_tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits; a number, name or unit keeps its value after its
    placeholder: 0d42, 0nmary, 0ukm. A name is a run of capitalised words that follows another word within
    its sentence; a run is one placeholder, 0nmaryann, for another name may have more words or fewer."""
    whole = F.coalesce(text, F.lit(""))
    joined = F.regexp_replace(whole, r"(?<=[0-9])[.,](?=[0-9])", "")
    numbered = F.regexp_replace(joined, "[0-9]+", " 0d$0 ")
    one = lambda t: F.regexp_replace(t, r" +0n(?<=0n\p{L}{1,80} {1,3}0n)", "")
    named = lambda t: one(F.lower(F.regexp_replace(t, r"\p{Lu}(?<=[\p{L}0-9][^\p{L}0-9.!?:]{1,6}\p{Lu})\p{Ll}\p{L}*", "0n$0")))
    units = F.regexp_replace(named(numbered), rf"(0d[0-9]+ +)({'|'.join(UNITS)})(?!\p{{L}})", "$1 0u$2")
    signs = F.regexp_replace(F.regexp_replace(units, r"(0d[0-9]+ *)[%€°]", "$1 0usign "), r"[$€£](?= *0d)", " 0usign ")
    return F.array_remove(F.split(F.when(whole.rlike("[0-9]"), signs).otherwise(named(whole)), r"[^\p{L}0-9]+"), "")


def _slot(token: Column) -> Column:
    return F.startswith(token, F.lit("0"))


def windows(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, position, hash of the placeholders and literals, and the marked tokens (null in
    windows without slots)."""
    def window(tokens: Column, canon: Column, i: Column) -> Column:
        parts = [F.get(canon, i + k) for k in range(WINDOW)]
        some = reduce(lambda a, b: a | b, (_slot(p) for p in parts))
        return F.struct(F.xxhash64(*parts).alias("h"), F.when(some, F.slice(tokens, i + 1, WINDOW)).alias("values"))

    def placed(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
        canon = F.transform(tokens, lambda t: F.when(_slot(t), F.substring(t, 1, 2)).otherwise(t))
        return F.when(F.size(tokens) >= WINDOW, let(canon, lambda c: F.transform(starts, lambda i: window(tokens, c, i))))

    df = rows.select(F.col(key).alias(key), let(marked_tokens(F.col(text)), placed).alias("_w"))
    # The outer form: else Spark computes the windows a second time to drop empty arrays first.
    return df.select(key, F.posexplode_outer("_w").alias("pos", "w")).select(key, "pos", "w.h", "w.values")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of the items. The first word's window stands in two forms, as a literal and as a name,
    for a document may go on with it in mid-sentence; windows with names also stand in lower case, as
    a copy without capitals or all in capitals holds them."""
    plain = windows(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")), "item_id")
    inside = benchmark.select(F.col(item).alias("item_id"), F.concat(F.lit("x "), F.col(text)).alias("text"))
    named = windows(inside, "item_id").where("pos = 1").withColumn("pos", F.lit(0))
    literals = F.when(F.col("values").isNull(), WINDOW).otherwise(F.size(F.filter("values", lambda t: ~_slot(t))))
    kept = plain.unionByName(named).where(F.col("h").isNotNull() & (literals >= LITERALS))
    lower = windows(benchmark.select(F.col(item).alias("item_id"), F.lower(F.col(text)).alias("text")), "item_id")
    kept = kept.unionByName(lower.join(kept.select("item_id", "pos").distinct(), ["item_id", "pos"], "left_semi"))
    return kept.groupBy("item_id", "pos", "h").agg(F.first("values").alias("values"))


def _consistent(found: Column) -> Column:
    """Places ``at`` of the windows of a diagonal that agree with its binding, or equal the item's.

    The binding of an item's value is the value of most of its places; of equally many the item's own,
    then that of the first place."""
    def slots_of(w: Column) -> Column:
        pairs = F.transform(w["asked"], lambda a, k: F.struct((w["at"] + k).alias("place"), a.alias("asked"), F.get(w["values"], k).alias("value")))
        return F.filter(pairs, lambda p: _slot(p["asked"]))

    def binding(slots: Column, asked: Column) -> Column:
        own = F.filter(slots, lambda p: p["asked"] == asked)
        ranked = lambda v: let(F.transform(F.filter(own, lambda p: p["value"] == v), lambda p: p["place"]), lambda at: F.struct(F.size(at), v == asked, -F.array_min(at), v.alias("value")))
        return F.array_max(F.transform(F.array_distinct(F.transform(own, lambda p: p["value"])), ranked))["value"]

    def kept(slots: Column) -> Column:
        asked = F.array_distinct(F.transform(slots, lambda p: p["asked"]))
        bound = F.transform(asked, lambda a: F.struct(a.alias("asked"), binding(slots, a).alias("value")))
        agrees = lambda bs, w: F.forall(slots_of(w), lambda p: F.exists(bs, lambda b: (b["asked"] == p["asked"]) & (b["value"] == p["value"])))
        return let(bound, lambda bs: F.filter(found, lambda w: w["asked"].isNull() | (w["asked"] == w["values"]) | agrees(bs, w)))

    with_slots = F.filter(found, lambda w: w["asked"].isNotNull())
    slots = F.array_distinct(F.flatten(F.transform(with_slots, slots_of)))
    told = F.when(F.size(with_slots) == 0, found).otherwise(let(slots, kept))
    return F.transform(told, lambda w: w["at"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it leaks: key, item_id, n_windows, n_found, coverage."""
    items = stored(item_windows(benchmark))
    sizes = items.groupBy("item_id").agg(F.count_distinct("pos").alias("n_windows"))
    theirs = small_side(items.select("item_id", F.col("pos").alias("at"), "h", F.col("values").alias("asked")), ITEM_ROWS)
    met = windows(docs, key, text).join(theirs, "h").select(F.col(key).alias("_key"), "item_id", "at", (F.col("pos") - F.col("at")).alias("diagonal"), "asked", "values")
    window = F.struct("at", "asked", "values")
    by_diagonal = met.groupBy("_key", "item_id", "diagonal").agg(F.collect_set(window).alias("found"))
    total = by_diagonal.groupBy("_key", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set(_consistent(F.col("found")))))).cast("long").alias("n_found"))
    told = total.join(small_side(stored(sizes)), "item_id").withColumn("coverage", F.round(F.col("n_found") / F.col("n_windows"), 6))
    return told.where(F.col("coverage") >= coverage).select(F.col("_key").alias(key), "item_id", "n_windows", "n_found", "coverage")


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; each row is judged alone, whatever its key."""
    rows = numbered(docs)
    return without_ids(rows, leaks(rows, benchmark, ROW, text), ROW).drop(ROW)
