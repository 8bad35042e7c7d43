"""Quality rules whose thresholds follow the data: a quantile sketch for each language and source.

A measure is a rate, smoothed by half a unit so that texts without any still differ by their length. Its
sketch counts rows by logarithmic bucket. Sketches merge by adding counts, in any order and with one
result, so those of a language, and of all rows, come from those of its sources. A group's fences lie a
number of quartile distances from its median, shrunk towards those of its language, and these towards
those of all rows: no cutoff is fixed. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import ASCII_SPACE
from graphfold.plans.lineage import cut as written

SYMBOLS = "#*$%&|<>"
NO_SYMBOLS = r"[^#*$%&|<>]++"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Measures: a count and what it is a share of. Each may be too high.
RATES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_words"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: May be too low as well.
LOW = ("word_length",)


@dataclass(frozen=True)
class Thresholds:
    """In buckets: fences at median + reach * (high - median) and median - reach * (median - low).

    A distance of quartiles counts as one bucket at least, which is what a sketch can tell apart.
    """

    low: float = 0.25
    high: float = 0.75
    reach: float = 7.0
    growth: float = 1.02  # of the buckets' borders: a quantile is off by 1 % at most
    prior_rows: int = 100  # a group's fence and that of the level above weigh alike at so many rows
    broadcast_rows: int = 20_000  # thresholds of more groups are joined by a shuffle


def words_of(text: Column) -> Column:
    """The words of a text, runs of anything but ASCII white space; none for null."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text.

    n_repeat_words: the hashes of all 3-word windows are sorted with their places; a window next to its
    equal is repeated, and the words under repeated windows are counted once each.
    """
    rows = df.select(*[F.col(c) for c in carry], F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("gf_text"))
    lines = F.filter(F.split("gf_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0)
    rows = rows.withColumn("gf_words", words_of(F.col("gf_text"))).withColumn("gf_lines", lines)
    rows = rows.select(
        *carry, "doc_id", "lang", "source", "gf_words",
        F.size("gf_words").cast("long").alias("n_words"),
        F.length(F.array_join("gf_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("gf_text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("gf_lines") - F.size(F.array_distinct("gf_lines"))).cast("long").alias("n_dup_lines"),
    )
    return rows.withColumn("n_repeat_words", repeated_words(F.col("gf_words")).cast("long")).drop("gf_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of a sort key that hold a window's place; the others hold the top of its hash.
PLACE_BITS = 20


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the array holds twice or more."""
    n = F.size(words)

    chained = lambda one: F.transform(F.slice(one, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(one, i + 1), F.get(one, i + 2)))
    windows = let(F.transform(words, lambda x: F.xxhash64(x)), chained)
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, count))


def covered(hashes: Column) -> Column:
    """The words under the windows whose hash comes twice or more.

    Keys of a hash's top and the window's place sort as plain numbers. Should two windows in the same
    text share that top but not the hash, or the place need more bits, whole hashes are sorted.
    """
    top, size = ~((1 << PLACE_BITS) - 1), F.size(hashes)
    place = lambda key: key.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")

    def from_keys(keys: Column) -> Column:
        same = F.filter(F.zip_with(F.slice(keys, 1, size - 1), F.slice(keys, 2, size - 1), lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0, F.struct(place(a).alias("i"), place(b).alias("j")))), lambda z: z.isNotNull())
        clash = lambda z: F.get(hashes, z["i"]) != F.get(hashes, z["j"])
        return let(same, lambda z: F.when(F.exists(z, clash), from_hashes()).otherwise(under_pairs(z)))

    def from_hashes() -> Column:
        ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), size - 1).alias("i")))
        near = lambda z: F.arrays_zip(F.slice(z.getField("h"), 1, size - 1).alias("a"), F.slice(z.getField("h"), 2, size - 1).alias("b"), F.slice(z.getField("i"), 1, size - 1).alias("i"), F.slice(z.getField("i"), 2, size - 1).alias("j"))
        return let(ordered, lambda o: let(F.filter(near(o), lambda z: z["a"] == z["b"]), under_pairs))

    keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(top).bitwiseOR(i.cast("long"))))
    return F.when(size < 1 << PLACE_BITS, let(keys, from_keys)).otherwise(from_hashes())


def under_pairs(same: Column) -> Column:
    """Words under windows: each holds 3, or as many as lie between its place and that of the one before."""

    def under(places: Column) -> Column:
        rest = F.size(places) - 1
        steps = F.zip_with(F.slice(places, 2, rest), F.slice(places, 1, rest), lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(steps, F.lit(3), lambda total, step: total + step)

    return let(F.sort_array(F.array_union(same.getField("i"), same.getField("j"))), lambda places: F.when(F.size(places) == 0, F.lit(0)).otherwise(under(places)))


def rates(measures: DataFrame, rule: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """The measures with the bucket of each rate: k holds the smoothed rates from growth^k up to growth^(k+1)."""
    smooth = lambda n, size: (2 * F.col(n) + 1).cast("double") / (2 * F.col(size) + 2).cast("double")
    return measures.withColumns({c: F.floor(F.log(smooth(*of)) / F.log(F.lit(rule.growth))).cast("int") for c, of in RATES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): rows by bucket, of rows that the fixed base rules let pass."""
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("measure"), F.col(c).alias("bucket")) for i, c in enumerate(RATES)]))
    values = rated.where(~base_failed()).select("lang", "source", entries.alias("e"))
    return values.groupBy("lang", "source", F.col("e.measure").alias("measure"), F.col("e.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str], rule: Thresholds) -> DataFrame:
    """A row for each group of keys: its number of rows, and under each measure a struct of its fences lo and hi, from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    held = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("rows"))

    def quantile(q: float) -> Column:
        """The bucket that holds the quantile. A sketch has a bounded number of buckets."""
        wanted = F.ceil(F.lit(q) * F.col("rows"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
        end = F.aggregate("b", start, lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + x["n"] >= wanted), x["bucket"]).otherwise(acc["at"]).alias("at")))
        return end["at"].cast("double")

    of = held.withColumns({"low": quantile(rule.low), "mid": quantile(0.5), "high": quantile(rule.high)})
    reach = lambda distance: rule.reach * F.greatest(distance, F.lit(1.0))
    fence = F.struct((F.col("mid") - reach(F.col("mid") - F.col("low"))).alias("lo"), (F.col("mid") + reach(F.col("high") - F.col("mid"))).alias("hi"))
    return of.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == i, fence)).alias(c) for i, c in enumerate(RATES)])


def shrunk(own: DataFrame, above: DataFrame, keys: list[str], rule: Thresholds) -> DataFrame:
    """The fences of own, weighed by its rows, with those of the level above, weighed by prior_rows. keys: above's."""
    up = above.select(*[F.col(k).alias(f"gf_{k}") for k in keys], F.struct(*RATES).alias("gf_above"))
    if keys:
        both = own.join(up, F.col(keys[0]).eqNullSafe(F.col(f"gf_{keys[0]}")))
    else:
        both = own.join(F.broadcast(up), F.lit(True))  # one row
    weighed = lambda c, side: (F.col("rows") * F.col(f"{c}.{side}") + rule.prior_rows * F.col(f"gf_above.{c}.{side}")) / (F.col("rows") + rule.prior_rows)
    mixed = [F.struct(weighed(c, "lo").alias("lo"), weighed(c, "hi").alias("hi")).alias(c) for c in RATES]
    return both.select(*[k for k in own.columns if k not in RATES], *mixed)


def thresholds(sketch: DataFrame, rule: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """Fences of each language and source, of each language, and of all rows."""
    whole = fences(sketch, [], rule)
    lang = shrunk(fences(sketch, ["lang"], rule), whole, [], rule)
    return shrunk(fences(sketch, ["lang", "source"], rule), lang, ["lang"], rule), lang, whole


def judge(rated: DataFrame, sketch: DataFrame, rule: Thresholds) -> DataFrame:
    """rated with base_failed and kept.

    The few fences come as a broadcast if there are at most broadcast_rows of them, else by a shuffle
    join whose hot keys adaptive execution splits. Null languages and sources are groups like any other.
    A group without fences has no row that passes the base rules.
    """
    own = thresholds(sketch, rule)[0].select(F.col("lang").alias("gf_lang"), F.col("source").alias("gf_source"), F.struct(*RATES).alias("gf_fence"))
    own = written(own, "fences")
    if own.limit(rule.broadcast_rows + 1).count() <= rule.broadcast_rows:
        own = F.broadcast(own)
    result = rated.join(own, F.col("lang").eqNullSafe(F.col("gf_lang")) & F.col("source").eqNullSafe(F.col("gf_source")), "left")
    beyond = F.lit(False)
    for c in RATES:
        beyond = beyond | (F.col(c) > F.col(f"gf_fence.{c}.hi"))
    for c in LOW:
        beyond = beyond | (F.col(c) < F.col(f"gf_fence.{c}.lo"))
    return result.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | F.coalesce(beyond, F.lit(True)))}).drop("gf_fence", "gf_lang", "gf_source")


def judged(df: DataFrame, rule: Thresholds, id_col: str, text_col: str, lang_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures, buckets and verdict of every row after the columns of carry. Texts are measured once, into a written table."""
    rated = written(rates(measure(df, id_col, text_col, lang_col, source_col, carry), rule), "measures")
    return judge(rated, written(sketches(rated), "sketches"), rule)


def quality(df: DataFrame, rule: Thresholds = Thresholds(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:  # noqa: B008
    """Measures and verdict of every row, whose narrow measures are written once between the two passes.

    A null text has no words and fails the base rules, as an empty one does. Rows that repeat are judged
    alike and come out as often as they came in. An empty table gives an empty result.
    """
    return judged(df, rule, id_col, text_col, lang_col, source_col)


def keep_good(df: DataFrame, rule: Thresholds = Thresholds(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:  # noqa: B008
    """The rows of df that are kept, with df's columns. The rows go through the written table, so that no text is shuffled or measured twice."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("gf_row"), F.col(id_col).alias("gf_i"), F.col(text_col).alias("gf_t"), F.col(lang_col).alias("gf_l"), F.col(source_col).alias("gf_s"))
    return judged(whole, rule, "gf_i", "gf_t", "gf_l", "gf_s", carry=("gf_row",)).where("kept").select("gf_row.*")
