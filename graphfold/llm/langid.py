"""Language identification by unigram models over a fixed vocabulary, summed over all segmentations.

Each language has a probability for each piece of a public vocabulary. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over
its words. The language with the highest posterior wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import map_batches, map_tasks, resident
from graphfold.llm.lattice import MARK, PieceMatcher, expected, forward, weights
from graphfold.llm.wordtable import NumberTable, slabs, split
from graphfold.plans.lineage import cut, drop

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: What parts the words of a text, which are looked up in bulk.
NO_LETTERS = r"[^\p{L}\p{M}]+"
UNDETERMINED = "und"
#: Letters of a word at most in training, and in a text; longer runs are cut into parts, as where a script sets no spaces.
LONGEST, LONGEST_RUN = 64, 4096


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    log_p: np.ndarray  # a row for each piece, a column for each language
    log_unknown: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # workers know the model, and while it is fitted its pieces, by it


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that a lower-case word may use; neither control nor byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return sorted({p for p in plain if regex.fullmatch(rf"{MARK}?[\p{{L}}\p{{M}}]*", p) and p == p.lower()})


def word_counts(training: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 1500, most_languages: int = 500) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, word, n): their words in a sample of labelled rows, lang a number in that list.

    About sample_docs whole documents of each language, chosen by a hash of their id. Of more languages
    than most_languages, those with the most rows take part. Runs of over LONGEST letters are cut into
    parts of that length. Rows without a language, and rows without text, take no part.
    """
    labelled = training.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where(F.col("l").isNotNull())
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_languages).collect()}
    languages = sorted(counts)
    if not languages:
        return [], labelled.select(F.lit(0).alias("lang"), F.col("t").alias("word"), F.lit(0).cast("long").alias("n"))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / counts[lang]))])
    chance = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    sample = labelled.where(chance < share[F.col("l")])
    words = sample.select(number[F.col("l")].alias("lang"), F.explode(F.regexp_extract_all(F.lower("t"), F.lit(rf"[\p{{L}}\p{{M}}]{{1,{LONGEST}}}"), F.lit(0))).alias("word"))
    return languages, words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit(training: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 1500, most_languages: int = 500, rounds: int = 3) -> LanguageModel:
    """Piece probabilities by expectation-maximisation over the words of a sample, see word_counts().

    Each round's expectations are worked out where the words lie; a row for each piece and language comes
    back, whatever the sample's size. With no labelled row the model has no language.
    """
    pieces = vocabulary(vocabulary_path)
    languages, words = word_counts(training, text_col, lang_col, id_col, sample_docs, most_languages)
    size, n = len(pieces), len(languages)
    model = LanguageModel(languages, pieces, np.full((size, n), -np.log(size)), np.full(n, -np.log(size) - 4))
    if not languages:
        return model
    words = cut(words.repartition(SPREAD, "word"), "words")
    for _ in range(rounds):
        model = improved(words, model)
    drop(words)
    return model


#: Parts that the training words are dealt to.
SPREAD = 32
#: Letters of training words that are gone through at once.
LETTERS_AT_ONCE = 20_000
#: Expectations are summed as whole numbers of this share, so that their order doesn't matter.
UNIT = 2.0**-20


def expectations(matcher: PieceMatcher, model: LanguageModel, lang: np.ndarray, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the table of pieces by languages, and in UNITs how often the words are expected to use them."""
    lattice = matcher.lattice([MARK + w for w in words])
    word = np.searchsorted(lattice.last, lattice.start)
    column = lang[word]
    weight = np.vstack([model.log_p, model.log_unknown])[lattice.piece, column]
    used = np.rint(counts[word] * expected(lattice, weight) / UNIT).astype(np.int64)
    known = lattice.piece >= 0
    cells, at = np.unique(lattice.piece[known] * len(model.languages) + column[known], return_inverse=True)
    sums = np.zeros(len(cells), np.int64)
    np.add.at(sums, at, used[known])
    return cells, sums


def improved(words: DataFrame, model: LanguageModel, prior: float = 0.5) -> LanguageModel:
    """The model after one round. The pooled model, and under it an even floor, smooth each language's."""
    sent = words.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary, whatever the input

    def run(batches):
        matcher = resident(("matcher", sent.value.name), lambda: PieceMatcher(sent.value.pieces))
        held: list[pa.RecordBatch] = []
        letters = 0

        def used() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            found = expectations(matcher, sent.value, table["lang"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["cell", "units"])

        for batch in batches:
            held.append(batch)
            letters += batch.nbytes
            if letters >= LETTERS_AT_ONCE:
                yield used()
                held, letters = [], 0
        if held:
            yield used()

    found = map_tasks(words, run, "cell long, units long").groupBy("cell").agg(F.sum("units").alias("units")).toArrow()
    size, n = model.log_p.shape
    gathered = np.zeros(size * n)
    gathered[found["cell"].to_numpy()] = found["units"].to_numpy() * UNIT
    sent.destroy()
    gathered = gathered.reshape(size, n)
    pooled = gathered.sum(1) + 1e-2
    pooled /= pooled.sum()
    smooth = gathered + prior * size * 1e-2 * pooled[:, None]
    log_p = np.log(smooth / smooth.sum(0))
    return LanguageModel(model.languages, model.pieces, log_p, log_p.min(0) - 1, model.name)


class Scorer(NumberTable):
    """Log probabilities of texts under each language; those of runs of letters are kept for reuse."""

    def __init__(self, model: LanguageModel, keep: int = 30_000_000) -> None:
        super().__init__(len(model.languages) + 1, keep)
        self.model = model
        self.matcher = PieceMatcher(model.pieces)

    def learn(self, chunks: list[str]) -> None:
        """Score chunks that are new: each run of letters in them is a word."""
        runs = [[c] if c.isalpha() and len(c) <= LONGEST_RUN else [w[i : i + LONGEST_RUN] for w in LETTERS.findall(c) for i in range(0, len(w), LONGEST_RUN)] for c in chunks]
        words = list(dict.fromkeys(w for r in runs for w in r))
        score = np.zeros((len(words), len(self.model.languages)))
        if words:
            lattice = self.matcher.lattice([MARK + w for w in words])
            score[:] = forward(lattice, weights(lattice, self.model.log_p, self.model.log_unknown))[lattice.last]
        at = {w: i for i, w in enumerate(words)}
        width = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((at[w] for r in runs for w in r), np.int64, int(width.sum()))
        full = np.flatnonzero(width)
        rows = np.zeros((len(chunks), self.width))
        if len(full):
            rows[full, :-1] = np.add.reduceat(score[flat], (np.cumsum(width) - width)[full], axis=0)
        rows[:, -1] = width
        self.append(rows)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its log probabilities, and whether it holds a letter."""
        sums = [self.sums(*split(pc.replace_substring_regex(pc.utf8_lower(slab), NO_LETTERS, " "), " ")) for slab in slabs(texts)]
        total = np.concatenate(sums) if sums else np.zeros((0, self.width))
        return total[:, :-1], total[:, -1] > 0


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text, after the columns named in carry.

    score is the posterior probability of lang_pred under equal priors. A null text, and one without a
    letter, gets `und` and 0.0; so does every text if the model knows no language. Equal posteriors go
    to the language that sorts first. Rows that repeat come out as often as they came in.
    """
    spark: SparkSession = df.sparkSession
    rows = df.select(*[F.col(c) for c in carry], F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(model)  # as large as the vocabulary, whatever the input
    labels = [*rows.columns[:-1], "lang_pred", "score"]

    def make():
        scorer = resident(("scorer", sent.value.name), lambda: Scorer(sent.value))
        names = np.array([*scorer.model.languages, UNDETERMINED], object)

        def step(batch: pa.RecordBatch):
            log_p, lettered = scorer.texts(batch.column(batch.num_columns - 1))
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if log_p.shape[1] and batch.num_rows:
                top = log_p.max(1)
                posterior = 1 / np.exp(log_p - top[:, None]).sum(1)
                best, score = np.where(lettered, log_p.argmax(1), best), np.where(lettered, posterior, 0.0)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score)], names=labels)

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return map_batches(rows, make, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True for the third of all documents that no model learns from. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
