"""Benchmark decontamination by template canonicalisation.

Numbers, in digits or in words, units after numbers, currency signs and capitalised words become typed
placeholders; blanks and marks only separate words.  Windows of five template words of the
documents are hash-joined with those of the benchmark items.  A document leaks an item when it
holds at least 0.8 of the item's windows in alignments whose placeholders are filled consistently:
within a type, equal fillings of the item stand for equal fillings of the document; windows with a
filling that stands for several don't count.  So a question with other numbers and names is caught, also with words put in, and a
chance likeness of templates is not.  A run of 15 words of a longer item is a leak as well, and so are
0.95 of the words of an item in their places: single changed or inserted words don't hide it.  A capitalised word is a name wherever it stands: the first word
of a sentence is one in the item and in its copy alike.  Items are also looked for in lower case.

Everything runs as DataFrame functions.  The item windows and the found documents are broadcast
only below a checked number of rows, and shuffled beyond it, with the same result.

Defined cases: null texts have no words; an item of fewer than five words has no window and is not
looked for; the first word of an item may be in lower case; a name in capitals throughout stands for
no other name, nor for its own; rows that are equal in ``doc_id`` and text share their result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, prepare, table, written

WINDOW, LEAST = 5, 0.8
#: A run of so many words of an item is a leak too, and so is this share of its words in their places.
RUN, WORDS = 15, 0.95
#: Windows by which a document is looked at word by word.
SEEDS = 3
#: Units that follow a number, marks that separate words.
UNITS = (
    "mm|cm|km|m|mg|kg|g|t|ml|cl|l|s|ms|min|h|kmh|mph|w|kw|v|a|j|kj|hz|khz|mhz|ghz|kb|mb|gb|tb|"
    "inches|inch|feet|foot|ft|yards|yard|miles|mile|pounds|pound|lbs|lb|ounces|ounce|oz|gallons|"
    "gallon|litres|litre|liters|liter|metres|metre|meters|meter|grams|gram|seconds|second|minutes|"
    "minute|hours|hour|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|"
    "cents|cent|percent|degrees|degree"
)
#: Cardinal and ordinal words.
NUMBER_WORDS = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|"
    "seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|"
    "million|billion|first|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|twice|thrice|dozen"
)
MARKS = ".,;:!?\"'()[]{}<>|*#&_~`^/\\-+="
NUMBER, UNIT, NAME = "⟨n⟩", "⟨u⟩", "⟨p⟩"
SLOT = "⟨[nup]⟩"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    """The text with blanks for marks; decimal marks stay within their number."""
    # The mark is looked at first: that settles nearly every position.
    joined = F.regexp_replace(text, r"[.,](?<=[0-9].)(?=[0-9])", "·")
    return F.regexp_replace(joined, "[" + re.escape(MARKS) + "]", " ")


def template(text: Column) -> Column:
    """Of a :func:`plain` text: as many words, the varying ones replaced by their type."""
    out = F.regexp_replace(text, r"[0-9][0-9·]*", NUMBER)
    out = F.regexp_replace(out, f"({NUMBER}[\\x20\\x09-\\x0D]?)(?i:{UNITS})(?![\\p{{L}}0-9⟨])", f"$1{UNIT}")
    # Number words stay for :func:`typed`, also at the start of a sentence.
    spelled = f"(?!(?i:{NUMBER_WORDS})(?![^\\x20\\x09-\\x0D]))"
    out = F.regexp_replace(
        out, r"(?=\p{Lu})(?<![^\x20\x09-\x0D])" + spelled + r"\p{Lu}\p{L}*\p{Ll}\p{L}*(?!\p{L})", NAME
    )
    return F.lower(F.regexp_replace(out, r"[$€£¥%°]", UNIT))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def typed(text: Column) -> Column:
    """The words of a :func:`plain` text, the varying ones replaced by their type, number words included."""
    numbers, units = NUMBER_WORDS.split("|"), UNITS.split("|")

    def spelled(tokens: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            unit = w.isin(*units) & F.get(tokens, i - 1).isin(*numbers)
            # Most words are neither: one look-up.
            return F.when(~w.isin(*numbers, *units), w).when(w.isin(*numbers), NUMBER).when(unit, UNIT).otherwise(w)

        return F.transform(tokens, word)

    return _let(words(template(text)), spelled)


def windows(tokens: Column) -> Column:
    """Hashes of all windows of five words, each of the hashes of its words: a word is hashed once."""
    n = F.size(tokens)
    return F.when(n >= WINDOW, _let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hashes: F.transform(
        F.slice(hashes, F.lit(1), n - WINDOW + 1),
        lambda first, i: F.xxhash64(first, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    ))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id n_item hash at``: the windows of each item and how many places they have."""
    base = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    # With names, with a first word within a sentence, and all in lower case.
    text = plain(F.col("text"))
    ways = _let(typed(text), lambda named: _let(typed(F.lower(text)), lambda literal: F.array(
        named, F.concat(F.slice(literal, 1, 1), F.slice(named, 2, 1 << 30)), literal
    )))
    each = base.select("item_id", F.explode(ways).alias("words"))
    placed = each.select("item_id", F.posexplode(windows(F.col("words"))).alias("at", "hash")).distinct()
    n = placed.groupBy(F.col("item_id").alias("of")).agg(F.count_distinct("at").alias("n_item"))
    return placed.join(n, placed["item_id"].eqNullSafe(n["of"])).drop("of")


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id text_hash item_id n_windows n_item n_slots`` of each document and item it leaks."""
    of_items = written(item_windows(items), "benchmark")
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    hashed = docs.select(*key, _let(typed(plain(F.col("text"))), windows).alias("hashes"))
    places = hashed.select("doc_id", "text_hash", F.posexplode("hashes").alias("pos", "hash"))
    hits = places.join(bounded(of_items), "hash")
    aligned = hits.groupBy("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("at"), F.max("n_item").alias("n_item")
    )
    found = aligned.groupBy("doc_id", "text_hash", "item_id").agg(
        F.collect_list(F.struct("shift", "at")).alias("ways"), F.max("n_item").alias("n_item")
    ).where(F.size(_places(F.col("ways"))) >= F.least(least * F.col("n_item"), F.lit(SEEDS))).select(
        "doc_id", "text_hash", "item_id", "n_item", F.transform("ways", lambda w: w["shift"]).alias("shifts")
    )
    return _consistent(docs, items, written(found, "leaks"), least)


def _places(ways: Column) -> Column:
    """Windows of the item that any of the alignments has."""
    return F.array_distinct(F.flatten(F.transform(ways, lambda w: w["at"])))


def _full(good: Column) -> Column:
    """Where the windows start all of whose words are good."""
    return F.filter(
        F.sequence(F.lit(0), F.size(good) - WINDOW),
        lambda at: F.forall(F.slice(good, at + 1, WINDOW), lambda g: g),
    )


def _words_of(at: Column) -> Column:
    """Places of the words of windows."""
    return F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(x, x + (WINDOW - 1)))))


def _aligned(shift: Column) -> Column:
    """``good slots`` of an alignment: whether each word of the item is in the document, and the
    different fillings of its windows.

    A filling of the item stands for one of the document; words whose filling has several are not
    good.  Several fillings of the item may share one of the document.
    """

    def word(at: Column) -> Column:
        kind, mine = F.get("i_kinds", at), F.get("i_words", at)
        theirs = F.get("t_words", at + shift)
        slot = kind.contains("⟨") & (kind == F.get("t_kinds", at + shift))
        # A word of the item that looks like a name may be one in lower case.
        same = (F.lower(theirs) == F.lower(mine)) & (~kind.contains(NAME) | (theirs == F.lower(theirs)))
        return F.struct(
            F.coalesce(slot, F.lit(False)).alias("slot"), F.coalesce(slot | same, F.lit(False)).alias("ok"),
            F.struct(kind.alias("kind"), F.lower(mine).alias("item")).alias("of"), F.lower(theirs).alias("doc"),
        )

    def fillings(read: Column) -> Column:
        held = F.transform(_words_of(_full(F.transform(read, lambda p: p["ok"]))), lambda at: F.get(read, at))
        return F.array_distinct(F.transform(F.filter(held, lambda p: p["slot"]), lambda p: F.struct(p["of"], p["doc"])))

    def clashing(slots: Column) -> Column:
        return _let(F.transform(slots, lambda f: f["of"]), lambda keys: F.when(
            F.size(F.array_distinct(keys)) < F.size(keys),
            F.filter(keys, lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1),
        ).otherwise(F.slice(keys, 1, 0)))

    def judged(read: Column, slots: Column) -> Column:
        return _let(clashing(slots), lambda bad: F.struct(
            F.transform(read, lambda p: p["ok"] & ~(p["slot"] & F.array_contains(bad, p["of"]))).alias("good"),
            F.size(slots).alias("slots"),
        ))

    read = F.transform(F.sequence(F.lit(0), F.size("i_words") - 1), word)
    return _let(read, lambda x: _let(fillings(x), lambda slots: judged(x, slots)))


def _run(good: Column) -> Column:
    """Words of the longest run of good ones."""
    return F.aggregate(good, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, g: _let(
        F.when(g, a["now"] + 1).otherwise(0), lambda now: F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))
    ), lambda a: a["most"])


def _held(good: Column) -> Column:
    return F.size(F.filter(good, lambda g: g))


def _most(ways: str, of) -> Column:
    return F.coalesce(F.array_max(F.transform(ways, lambda w: of(w["good"]))), F.lit(0))


def _consistent(docs: DataFrame, items: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Those that hold enough of the item in alignments whose placeholders are filled alike; looks
    at the found documents only."""
    key = ["doc_id", "text_hash"]
    few = found.select(*[F.col(c).alias(f"f_{c}") for c in key]).distinct()
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    theirs = read.join(
        bounded(few),
        read["doc_id"].eqNullSafe(few["f_doc_id"]) & (read["text_hash"] == few["f_text_hash"]), "left_semi",
    ).dropDuplicates(key).select(
        F.col("doc_id").alias("t_doc_id"), F.col("text_hash").alias("t_text_hash"),
        words(plain(F.col("text"))).alias("t_words"),
        typed(plain(F.col("text"))).alias("t_kinds"),
    )
    text = F.coalesce("text", F.lit(""))
    own = items.select(
        F.col("item_id").alias("i_item_id"), words(plain(text)).alias("i_words"), typed(plain(text)).alias("i_kinds"),
    ).dropDuplicates(["i_item_id"])
    both = found.join(
        theirs, found["doc_id"].eqNullSafe(theirs["t_doc_id"]) & (found["text_hash"] == theirs["t_text_hash"])
    ).join(own, found["item_id"].eqNullSafe(own["i_item_id"]))
    judged = both.select(
        *key, "item_id", "n_item", F.size("i_words").alias("n_words"),
        F.transform("shifts", _aligned).alias("ways"),
    ).withColumn("ways", F.filter(F.transform("ways", lambda w: F.struct(
        _full(w["good"]).alias("at"), w["good"].alias("good"), w["slots"].alias("slots")
    )), lambda w: F.size(w["at"]) > 0))
    return judged.withColumn("n_windows", F.size(_places(F.col("ways"))).cast("long")).where(
        (F.col("n_windows") >= least * F.col("n_item"))
        | (_most("ways", _run) >= RUN)
        | (_most("ways", _held) >= WORDS * F.col("n_words"))
        | (F.size(_words_of(_places(F.col("ways")))) >= WORDS * F.col("n_words"))
    ).select(
        *key, "item_id", "n_windows", "n_item",
        F.array_max(F.transform("ways", lambda w: w["slots"])).cast("long").alias("n_slots"),
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    found = written(leaks(docs, items).select(
        F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_text")
    ).distinct(), "leaking")
    return docs.join(
        bounded(found),
        docs["doc_id"].eqNullSafe(F.col("__leak_id")) & (F.xxhash64(docs["text"]) == F.col("__leak_text")), "left_anti",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", "n_windows", "n_item",
        (F.col("n_windows") / F.col("n_item")).alias("share"), "n_slots",
    )
