"""Near duplicates by b-bit MinHash.

Each document's set of word shingles gives 240 minima. Bands of 5 name candidates; of each minimum four
bits are kept, and the share of equal bits, corrected for chance, drops candidates far from the
threshold; the rest is confirmed on whole sets. Equal sets are one class from the start.

In a bucket not all pairs are formed. Every member meets the bucket's hub, the member that shares buckets
with most others, as the original of many copies does. Where members of a bucket are still in different
components, an exact join finds all links between these: two linked sets have their first common shingle,
in an order that is the same for all, near the beginning of both. Shingles that only one component has
come first in that order, so that what is unlike others meets nobody.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphfold.llm.common import map_batches, resident, two_columns, with_ids
from graphfold.llm.wordtable import slabs
from graphfold.operators.components import components
from graphfold.plans.lineage import cut, drop


@dataclass(frozen=True)
class NearRule:
    """Documents are linked if percent * |union| <= 100 * |intersection|.

    With 48 bands of 5 minima, a pair at similarity 0.75 shares no band in 2 of a million cases, and one
    at 0.3 shares one in 11 of a hundred. The estimate's standard deviation at 0.75 is 0.029; below the
    threshold by least_gap, 4.8 of those, a candidate is dropped.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 48
    rows: int = 5
    least_gap: float = 0.14
    seed: int = 7


_MASK_BITS = 4
_TAKE = 20  # the bits kept are these above the lowest, which a product mixes least
#: A hub's members are dealt to so many parts at most, each of which has the hub's text once.
_PARTS = 4096


class Sketcher:
    """Shingle sets of texts, and the minima of their hashes."""

    def __init__(self, rule: NearRule) -> None:
        self.rule = rule
        rng = np.random.default_rng(rule.seed)
        count = rule.bands * rule.rows
        self.factor = rng.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 2**63, count, np.uint64)
        self.mix = np.uint64(0x9E3779B97F4A7C15)

    def stir(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * self.mix
        return h ^ (h >> np.uint64(29))

    def shingles(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted hashes of each text's set."""
        size = self.rule.shingle
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = parts.offsets.to_numpy()
        words = parts.flatten()
        full = pc.binary_length(words).to_numpy() > 0  # a border at a text's end leaves an empty part
        ends = np.append(0, np.cumsum(full))[ends - ends[0]]
        coded = words.filter(pa.array(full)).dictionary_encode()
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
        chained = hashes[: max(0, len(hashes) - size + 1)].copy()
        for j in range(1, size):
            chained = self.stir(chained) + hashes[j : j + len(chained)]
        chained = self.stir(chained)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(chained[a : b - size + 1]))
            elif b > a:
                whole = np.array([b - a], np.uint64)  # the length sets it apart from a shingle
                for h in hashes[a:b]:
                    whole = self.stir(whole) + h
                out.append(self.stir(whole))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[at : at + 1024, None] * self.factor + self.offset).min(0), out=least)
        return least

    def bits(self, minima: np.ndarray) -> np.ndarray:
        """Four bits of each minimum, packed into rows of longs."""
        four = (minima >> np.uint64(_TAKE)).astype(np.uint8) & 15
        return np.ascontiguousarray(four[:, 0::2] | four[:, 1::2] << 4).view("<i8")

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """A hash of each band's minima and of the band's number."""
        grouped = minima.reshape(len(minima), self.rule.bands, self.rule.rows)
        key = np.broadcast_to(np.arange(1, self.rule.bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
        for j in range(self.rule.rows):
            key = self.stir(key) + grouped[:, :, j]
        return self.stir(key).view(np.int64)


def sketches(docs: DataFrame, rule: NearRule) -> DataFrame:
    """(doc_id, n_shingles, key, sig, bands) of (doc_id, text): key is a digest of the set, null if it is empty."""

    def make():
        sketcher = resident(("sketcher", rule), lambda: Sketcher(rule))

        def step(batch: pa.RecordBatch):
            at = 0
            for slab in slabs(batch.column(1), 2_000_000):
                sets = sketcher.shingles(slab)
                least = np.array([sketcher.minima(s) for s in sets]).reshape(len(sets), -1)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig, bands = sketcher.bits(least), sketcher.band_keys(least)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (sig, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *lists], names=["doc_id", "n_shingles", "key", "sig", "bands"])
                at += len(sets)

        return step

    return map_batches(docs, make, "doc_id long, n_shingles long, key binary, sig array<long>, bands array<long>")


def word_set(text: str, size: int) -> frozenset:
    """The set itself, of tuples of words."""
    words = text.encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, rule: NearRule) -> DataFrame:
    """The pairs (a, b) that are linked by their whole sets.

    b is a hub. Its members are dealt to parts, each with the hub's text first; a task reads them in
    order and holds one hub's set at a time.
    """
    members = pairs.select("b", F.pmod(F.xxhash64("a"), F.lit(_PARTS)).alias("part"), F.lit(1).alias("role"), F.col("a").alias("id"))
    hubs = members.select("b", "part", F.lit(0).alias("role"), F.col("b").alias("id")).distinct()
    rows = hubs.unionByName(members).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.select("b", "part", "role", "id", "text").repartition("b", "part").sortWithinPartitions("b", "part", "role", "id")

    def make():
        state = {"hub": None, "set": frozenset()}

        def step(batch: pa.RecordBatch):
            out = [], []
            for b, part, role, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = word_set(text or "", rule.shingle)
                if role == 0:
                    state.update(hub=(b, part), set=own)
                elif state["hub"] == (b, part):
                    common = len(own & state["set"])
                    if common and 100 * common >= rule.percent * (len(own) + len(state["set"]) - common):
                        out[0].append(i)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        return step

    return map_batches(rows, make, "a long, b long")


def sizes_allow(n_a, n_b, rule: NearRule):
    return 100 * F.least(n_a, n_b) >= rule.percent * F.greatest(n_a, n_b)


def likely(pairs: DataFrame, signatures: DataFrame, rule: NearRule) -> DataFrame:
    """The pairs whose bits don't speak against a link.

    Of unequal minima, one in 16 agrees in four bits; the similarity is (agreeing - 1/16) / (1 - 1/16).
    """
    side = lambda x: signatures.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    chance = 1 / (1 << _MASK_BITS)
    longs = rule.bands * rule.rows * _MASK_BITS // 64

    def differing(i: int):
        x = F.get("sig_a", F.lit(i)).bitwiseXOR(F.get("sig_b", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(0x1111111111111111))

    agree = 1 - sum((differing(i) for i in range(longs)), F.lit(0)) / float(rule.bands * rule.rows)
    return both.where((agree - chance) / (1 - chance) >= rule.percent / 100 - rule.least_gap).select("a", "b")


def hub_pairs(shared: DataFrame, rule: NearRule) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's hub b, if their sizes allow a link. shared: (bucket, rep, n, size)."""
    score = shared.groupBy("rep").agg(F.sum("size").alias("score"))
    hubs = shared.join(score, "rep").groupBy("bucket").agg(F.max(F.struct("score", F.xxhash64("rep").alias("h"), "rep", "n")).alias("hub"))
    met = shared.join(hubs, (shared["bucket"] == hubs["bucket"]) & (F.col("rep") != F.col("hub.rep")) & sizes_allow(F.col("n"), F.col("hub.n"), rule))
    return met.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct()


def grams(texts: DataFrame, rule: NearRule) -> DataFrame:
    """(doc_id, grams): the hashes of each text's set."""

    def make():
        sketcher = resident(("sketcher", rule), lambda: Sketcher(rule))

        def step(batch: pa.RecordBatch):
            at = 0
            for slab in slabs(batch.column(1), 2_000_000):
                sets = [s.view(np.int64) for s in sketcher.shingles(slab)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "grams"])
                at += len(sets)

        return step

    return map_batches(texts.select("doc_id", "text"), make, "doc_id long, grams array<long>")


def prefix_pairs(sets: DataFrame, rule: NearRule) -> DataFrame:
    """(a, b): all pairs of different components that may be linked, of (rep, n, component, held, grams).

    Shingles are ordered: those of one component only first, then by the number of sets that hold them. A
    link of sets of n and m shingles needs percent * (n + m) / (100 + percent) common ones. If the first of
    these stands at places p and q, counted from 0, no more than n - p and m - q are left; so the pair is
    formed at this shingle. A shingle's main component is that of its largest one; sets of it meet the
    others only. held is the number of sets that a component has.
    """
    entries = sets.select("rep", "n", "component", "held", F.explode("grams").alias("gram"))
    stats = entries.groupBy("gram").agg(F.count("*").alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", "held").alias("main")).where("lo < hi").select("gram", "often", "main")
    common = entries.join(stats, "gram")
    by_rep = Window.partitionBy("rep")
    place = F.col("n") - F.count("*").over(by_rep) + F.row_number().over(by_rep.orderBy("often", "gram")) - 1
    need = lambda n, m, left: (100 + rule.percent) * left >= rule.percent * (n + m)
    left = common.withColumn("left", F.col("n") - place).where(100 * F.col("left") >= rule.percent * F.col("n"))
    left = cut(left.select("rep", "n", "component", "gram", "main", "left"), "prefixes")
    # A class of sizes spans a ratio of 7 to 6; linked sets lie so many classes apart at most.
    wide = 1 + int(np.ceil(np.log(100 / rule.percent) / np.log(7 / 6)))
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(7 / 6))).cast("int")
    least = F.floor(F.pow(F.lit(7 / 6), F.col("grade").cast("double")) * (1 - 1e-9))
    one = left.where("component <> main").withColumn("grade", F.explode(F.sequence(grade - wide, grade + wide)))
    one = one.where(need(F.col("n"), least, F.col("left"))).select("gram", "grade", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "component", "left")])
    other = left.withColumn("grade", grade).select("gram", "grade", "main", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "component", "left")])
    fits = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b"))) & sizes_allow(F.col("n_a"), F.col("n_b"), rule)
    for side in "ab":
        fits = fits & need(F.col("n_a"), F.col("n_b"), F.col(f"left_{side}"))
    met = one.join(other, (one["gram"] == other["gram"]) & (one["grade"] == other["grade"]) & fits)
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, rule: NearRule = NearRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id, kept) of every row.

    component_id is the smallest doc_id reachable over links, the own one included; kept marks the row
    that has it. A text without words has no links; so has a row without a doc_id, whose component is
    null and which is kept. Ids are meant to be unique: rows that repeat an id are one document, each
    comes out, and equal sets link them as any others. Shingles are counted by hashes of 64 bits, and
    sets are equal if a digest of 128 bits of those is.
    """
    docs = two_columns(df, id_col, text_col)
    drawn = cut(sketches(docs, rule), "sketches")
    known = drawn.where("doc_id is not null and key is not null")
    first = known.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("s"))
    classes = cut(first.select("key", F.col("s.doc_id").alias("rep"), F.col("s.n_shingles").alias("n"), "s.sig", "s.bands"), "classes")
    entries = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(entries.join(sizes, "bucket"), "buckets")
    sharing = cut(shared.select("rep").distinct(), "sharing")
    signatures = cut(with_ids(classes.select("rep", "sig"), "rep", sharing), "signatures")
    texts = cut(with_ids(docs, "doc_id", sharing.withColumnRenamed("rep", "doc_id")), "texts")
    links = cut(confirmed(cut(likely(hub_pairs(shared, rule), signatures, rule), "pairs"), texts, rule), "links")
    linked = components(links)
    labels = cut(sharing.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels")
    # A bucket of two has been dealt with. In others, all that a link to another component could have left out are looked at.
    spread = shared.where("size > 2").join(labels, "rep")
    apart = spread.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    still = cut(spread.join(apart, "bucket", "left_semi").select("rep", "n", "component").distinct(), "open")
    held = still.groupBy("component").agg(F.count("*").alias("held"))
    sets = still.join(held, "component").join(grams(with_ids(texts, "doc_id", still.select(F.col("rep").alias("doc_id"))), rule).withColumnRenamed("doc_id", "rep"), "rep")
    sets = cut(sets, "sets")
    more = cut(confirmed(cut(prefix_pairs(sets, rule), "pairs"), texts, rule), "links")
    drop(shared, signatures, texts, sets)
    if more.limit(1).count():
        linked = components(links.unionByName(more))
    member = classes.select("key", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    own = drawn.select("doc_id", "n_shingles", "key")
    whole = own.where("key is not null").join(member, "key", "left").unionByName(own.where("key is null").withColumn("component_id", F.lit(None).cast("long")))
    return whole.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, rule: NearRule = NearRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row of each group, with df's columns: that of the smallest id. A row without an id stays."""
    judged = cut(near_duplicates(df, rule, id_col, text_col).select(F.col("doc_id").alias("gf_id"), "kept"), "kept")
    twice = judged.where("kept and gf_id is not null").groupBy("gf_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    gone = judged.where("not kept").select("gf_id").distinct()
    rest = with_ids(df, id_col, cut(gone.withColumnRenamed("gf_id", id_col), "gone"), how="left_anti")
    if not twice:
        return rest
    whole = rest.where(F.col(f"`{id_col}`").isNotNull())
    return whole.dropDuplicates([id_col]).unionByName(rest.where(F.col(f"`{id_col}`").isNull()))
