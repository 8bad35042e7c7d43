"""Secret scans: three kinds by pattern, a fourth by sliding-window entropy. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they are listed, and the fixed kinds' patterns. The runs of
#: access and hex are maximal, so that their least length can stand in the pattern; what assign takes
#: can hold another match, so that its least length is tested afterwards.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"


_HARD = "bcdfghjklmnpqrstvwxz"


@dataclass(frozen=True)
class EntropyRule:
    """A candidate is a run of the alphabet; a window of it is random if its entropy reaches its class's bits.

    The classes, by what a run holds: digits only; else hexadecimal digits only; else letters of one case
    only; else letters and digits only; else more. No digit is asked for: words, numbers, UUIDs and
    placeholders are cut out of a candidate, and the runs that are left are tested. Words are told by how
    their letters follow each other, as a random run of letters holds too many consonants in a row or
    pairs that words don't have.
    """

    window: int = 20
    digit_bits: float = 2.5
    hex_bits: float = 3.0
    letter_bits: float = 3.3
    alnum_bits: float = 3.6
    wide_bits: float = 3.8
    candidate: str = r"[A-Za-z0-9+/_=-]{20,}+"
    #: Cut out: a UUID or a placeholder, wherever it stands; and a part between marks that is of words, up
    #: to four digits after them, or a number or date of up to eight digits, unless it is unlike words.
    #: Parts of fewer than four characters are left, as chance puts them between the marks of a key.
    allow: tuple[str, ...] = (
        r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",
        r"(?i)example|placeholder|x{4,}+|lorem",
    )
    marks: str = r"(?<=[/_=+\n-])|(?=[/_=+\n-])"
    allow_part: str = r"^(?=.{4})(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++[0-9]{0,4}|[0-9]{4,8})$"
    unlike_words: str = rf"(?i)[{_HARD}]{{7}}|[jq][{_HARD}]|x[bdfgjkmnrsvwxz]|z[bcdfgjkmnpqrsvx]|[bcdfgkmnpstvwz]x|[bcdfghjklmnprstvwxz]q|[bcfghklmpstvwxz]j|v[bcdfghjkmnpqstwz]|w[cjqvxz]|[fghkpv]z(?!w)"


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array's values joined up to each place, whole numbers from 0 on.

    Arrays are copied when they grow, so values go in blocks of about the square root of their number.
    """
    none = F.array().cast("array<long>")

    def plain(part: Column) -> Column:
        return F.aggregate(part, none, lambda done, x: F.concat(done, F.array(join(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long")), x.cast("long")))))

    def joined_blocks(blocks: Column) -> Column:
        def moved(ends: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda own, k: F.when(k == 0, own).otherwise(F.transform(own, lambda x: join(F.get(ends, k - 1), x)))))

        return let(plain(F.transform(blocks, lambda own: F.element_at(own, -1))), moved)

    def in_blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        starts = lambda w: F.sequence(F.lit(1), F.size(v), w)
        return let(width, lambda w: let(F.transform(starts(w), lambda i: plain(F.slice(v, i, w))), joined_blocks))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(in_blocks(v)))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs of start, kind, end and the matched text, in code points.

    The text between matches and the matches take turns, so that their lengths add up to the places.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def places(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        ends = running(F.zip_with(gaps, matches, lambda gap, match: F.length(gap) + F.length(match)), lambda a, b: a + b)
        place = lambda match, end: F.struct((end - F.length(match)).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), match.alias("match"))
        return F.zip_with(matches, ends, place)

    hits = lambda: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return F.when(F.rlike(text, F.lit(pattern)), hits()).otherwise(empty)


#: Windows of a run that are gone through at once; the first piece with a hit ends the search.
PIECE = 512
#: Characters of a text's blocks, in redaction.
BLOCK = 4096
#: Counts of 128 characters, a byte each, 8 in a long.
LONGS = 16


def random_run(run: Column, rule: EntropyRule) -> Column:
    """Whether some window of the run, of ASCII characters, has the entropy of its class.

    The sum of c * log2(c) over a window's characters, c times each, moves on with the window: the
    character that leaves and the one that enters change one count and one term each. The entropy is
    log2(window) - sum / window. Time grows with the run's length. A window has 127 characters at most.
    """
    w = rule.window
    holds = lambda pattern: F.rlike(run, F.lit(pattern))
    bits = F.when(holds(r"^[0-9]+$"), rule.digit_bits).when(holds(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), rule.hex_bits).when(holds(r"^(?:[a-z]+|[A-Z]+)$"), rule.letter_bits).when(holds(r"^[A-Za-z0-9]+$"), rule.alnum_bits).otherwise(rule.wide_bits)
    terms = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(w + 2)])
    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

    def least(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(chars, i), F.when(i >= w, F.get(chars, i - w)).otherwise(F.lit(-1))
            bits = lambda c: c.bitwiseAND(7) * 8
            count = lambda c: F.call_function("shiftright", F.get(acc["counts"], F.shiftright(c, 3)), bits(c)).bitwiseAND(127)
            one = lambda c, k: F.when(F.shiftright(c, 3) == k, F.call_function("shiftleft", F.lit(1).cast("long"), bits(c))).otherwise(F.lit(0).cast("long"))
            term = lambda c: F.get(terms, c.cast("int"))
            into = count(enters) - F.when(leaves == enters, 1).otherwise(0)
            gone = F.when(leaves < 0, 0.0).otherwise(term(count(leaves) - 1) - term(count(leaves)))
            counts = F.transform(acc["counts"], lambda x, k: x + one(enters, k) - F.when(leaves < 0, F.lit(0).cast("long")).otherwise(one(leaves, k)))
            return F.struct(counts.alias("counts"), (acc["sum"] + gone + term(into + 1) - term(into)).alias("sum"), F.when(i >= w, F.least(acc["least"], acc["sum"])).otherwise(acc["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, lambda acc: F.least(acc["least"], acc["sum"]))

    def hit(piece: Column) -> Column:
        codes = F.transform(F.split(piece, ""), lambda x: F.ascii(x))
        return F.when(F.length(piece) < w, False).otherwise(let(codes, lambda chars: F.log2(F.lit(float(w))) - least(chars) / w >= bits - 1e-9))

    pieces = F.regexp_extract_all(run, F.lit(rf"(?=(.{{1,{PIECE + w - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.exists(pieces, hit)


def unexplained(match: Column, rule: EntropyRule) -> Column:
    """The runs of a candidate that are left without the parts that the rule allows."""
    for pattern in rule.allow:
        match = F.regexp_replace(match, F.lit(pattern), F.lit("\n"))
    allowed = lambda part: F.rlike(part, F.lit(rule.allow_part)) & ~F.rlike(part, F.lit(rule.unlike_words))
    parts = F.transform(F.split(match, rule.marks), lambda part: F.when(allowed(part), F.lit("\n")).otherwise(part))
    return F.split(F.array_join(parts, ""), "\n")


def entropy_spans(text: Column, rule: EntropyRule) -> Column:
    """Candidates with a random window outside their allowed parts."""

    def random(run: Column) -> Column:
        return F.when(F.length(run) >= rule.window, random_run(run, rule)).otherwise(False)

    return F.filter(spans_of(text, rule.candidate, 3), lambda x: F.exists(unexplained(x["match"], rule), random))


def scan(df: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(doc_id, base, found) of every row after the columns of carry: spans by start, then kind as listed.

    A span is a struct of start, kind's number and end, in code points, end exclusive. base holds the
    fixed kinds; found adds those of the entropy rule that no base span covers. A null or empty text
    has none. Rows that repeat come out as often as they came in.
    """
    text = F.col("gf_text")
    rows = df.select(*[F.col(c) for c in carry], F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("gf_text"))
    value = lambda x: F.regexp_extract(x["match"], ASSIGN, 2)
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda x: F.length(value(x)) >= ASSIGN_LEAST)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    base = F.sort_array(bare(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))))
    rows = rows.withColumns({"base": base, "gf_more": bare(entropy_spans(text, rule))})
    return rows.withColumn("found", united(F.col("base"), F.col("gf_more"))).drop("gf_more")


def united(base: Column, more: Column) -> Column:
    """base and what of more no span of base covers, by start, then kind; more's kind comes last."""
    late = lambda spans, flag: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(flag).alias("late"), x["kind"].alias("kind"), x["end"].alias("end")))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))

    def uncovered(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: F.when(x["late"] == 0, x["end"]).otherwise(0)), F.greatest)
        alone = F.filter(F.zip_with(spans, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda z: (z["x"]["late"] == 0) | (z["r"] < z["x"]["end"]))
        return F.transform(alone, lambda z: bare(z["x"]))

    return F.when(F.size(more) == 0, base).otherwise(let(F.sort_array(F.concat(late(base, 0), late(more, 1))), uncovered))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(df: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    found = scan(df, rule, id_col, text_col)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(df: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:  # noqa: B008
    """df with each secret in the text replaced by a mark, overlapping ones by one, and the length made to fit."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("gf_row"), F.col(id_col).alias("gf_i"), F.col(text_col).alias("gf_t"))
    found = scan(whole, rule, "gf_i", "gf_t", carry=("gf_row", "gf_t"))

    def without(blocks: Column) -> Column:
        """The text between spans, and a mark for each run of overlapping ones. Blocks of the text keep a part's place near."""

        def part(begin: Column, end: Column) -> Column:
            inside = lambda k: F.substr(F.get(blocks, k), F.greatest(begin - k * BLOCK, F.lit(0)) + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - F.greatest(begin - k * BLOCK, F.lit(0)))
            first, last = F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
            return F.when(end <= begin, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, last), inside), ""))

        def rebuilt(ends: Column) -> Column:
            before = F.transform(F.col("found"), lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long")).cast("int").alias("at")))
            apart = F.filter(before, lambda z: z["start"] >= z["at"])
            tail = part(F.element_at(ends, -1).cast("int"), F.length("gf_text"))
            return F.concat(F.array_join(F.transform(apart, lambda z: F.concat(part(z["at"], z["start"]), F.lit(mark))), ""), tail)

        return let(running(F.transform("found", lambda x: x["end"]), F.greatest), rebuilt)

    rebuilt = let(F.regexp_extract_all("gf_text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), without)
    clean = F.when(F.size("found") > 0, rebuilt).otherwise(F.col("gf_t"))
    found = found.withColumn("gf_clean", clean)
    columns = [F.col("gf_clean").alias(c) if c == text_col else F.when(F.size("found") > 0, F.length("gf_clean")).otherwise(F.col(f"gf_row.`{c}`")).cast(df.schema[c].dataType).alias(c) if c == length_col else F.col(f"gf_row.`{c}`").alias(c) for c in df.columns]
    return found.select(*columns)
