"""Quality classifier from weak labels.

Heuristic labellers vote *reject* or abstain on two questions, junk and toxic.  Expectation
maximisation over the counts of all vote patterns of all documents estimates how often each
labeller fires on good and on bad documents (documents whose votes agree by chance of the class).
The posterior of a document's pattern is its label, and the labels train a linear scorer over
hashed words and votes, which starts from the weights that the estimates imply.  A document is
rejected when the scorer gives either question one half or more.

What is fitted on samples: the words that mark toxic texts, from at most ``labelled_rows`` labelled
rows, and the scorer, from about ``training_rows`` documents (arguments of :func:`fit`); both are picked by a hash of
``doc_id``.  Vote patterns are counted over all documents, and every whole text is scored.

Defined cases: a null or empty text gets no votes and the score of a document without any; rows
may repeat and are scored alike; without labels or documents the word list is empty, or there is
nothing to fit and the starting estimates stand.
"""

from __future__ import annotations

import math
import operator
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, prepare, table, utf8

#: Defaults of the two sample sizes.
LABELLED_ROWS, TRAINING_ROWS = 20_000, 20_000
#: Hashed word features; share of the estimated vote weights that training starts from.
SIZE, VOTE_SHARE = 1 << 17, 0.6
#: A word marks toxic texts when so many of the labelled toxic texts have it, so many times as
#: large a share as of the others.
WORD_ROWS, WORD_LIFT = 5, 30.0

#: Insults.
INSULTS = frozenset(
    b"idiot idiots moron morons stupid imbecile imbeciles dumb dumbass fool fools cretin dimwit clown "
    b"clowns loser losers worthless pathetic useless trash scum scumbag filth filthy vermin garbage "
    b"disgusting disgrace pig pigs bastard bastards bitch bitches asshole assholes jerk jerks crap "
    b"shit fuck fucking fucker retard retarded whore slut creep parasite parasites maggot".split()
)
MARKS = b"!#$%&*|~^=@\\<>{}_+"
DOUBLED = tuple(bytes([c, c]) for c in b"!#$%&*?|~^=@")
UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
BLANKED = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
#: The questions and their labellers; each votes reject (1) or abstains (0).
LABELLERS = {
    "junk": ("doubled_marks", "capitals", "lone_marks", "stutter", "marks", "few_words"),
    "toxic": ("insult", "insults", "learned", "learned_twice", "dense"),
}
START = {"prior": 0.1, "bad": 0.4, "good": 0.01}


# --- one document ----------------------------------------------------------------------------

def vocabulary(data: bytes) -> set[bytes]:
    return set(data.lower().translate(BLANKED).split())


def votes(data: bytes, vocab: set[bytes], learned: frozenset[bytes]) -> tuple[int, int]:
    """The votes on junk and on toxic as bits, in the order of :data:`LABELLERS`."""
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0
    upper = len(data) - len(data.translate(None, UPPER))
    lower = len(data) - len(data.translate(None, LOWER))
    marks = len(data) - len(data.translate(None, MARKS))
    doubled = sum(map(data.count, DOUBLED))
    lone = sum(1 for w in words if len(w) < 4 and not w.translate(None, MARKS))
    same = sum(map(operator.eq, words, words[1:]))
    junk = (
        doubled > 0.05 * n,
        upper > 0.4 * (upper + lower) and upper > 5,
        lone > 0.05 * n and lone > 2,
        same > 0.1 * n,
        marks > 0.03 * len(data),
        n >= 20 and len(vocab) < 0.25 * min(n, 400),
    )
    insults, marked = len(vocab & INSULTS), len(vocab & learned)
    toxic = (
        insults >= 1, insults >= 2, marked >= 1, marked >= 2,
        insults + marked >= 2 and (insults + marked) * 150 > n,
    )
    return sum(b << i for i, b in enumerate(junk)), sum(b << i for i, b in enumerate(toxic))


def hashed(vocab: set[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, vocab), np.int64, len(vocab)) & (SIZE - 1)


# --- estimates -------------------------------------------------------------------------------

@dataclass
class Estimates:
    """How often each labeller fires on bad and on good documents, and the share of bad ones."""

    bad: np.ndarray
    good: np.ndarray
    prior: float

    def weights(self) -> tuple[np.ndarray, float]:
        """Weight of each vote and the constant: the log odds of a vote pattern."""
        fires = np.log(self.bad / self.good)
        silent = np.log((1 - self.bad) / (1 - self.good))
        return fires - silent, math.log(self.prior / (1 - self.prior)) + silent.sum()


def estimate(patterns: np.ndarray, counts: np.ndarray, n_labellers: int, rounds: int = 100) -> Estimates:
    """Expectation maximisation over (votes as bits, number of documents).

    Pseudo-counts keep every rate inside (0, 1), and a labeller may not fire more on good
    documents than on bad ones.
    """
    fires = (patterns[:, None] >> np.arange(n_labellers) & 1).astype(float)
    now = Estimates(np.full(n_labellers, START["bad"]), np.full(n_labellers, START["good"]), START["prior"])
    total = counts.sum()
    if not total:
        return now
    for _ in range(rounds):
        vote, constant = now.weights()
        p = 1 / (1 + np.exp(-np.clip(fires @ vote + constant, -500, 500)))
        bad, good = counts * p, counts * (1 - p)
        rate_bad = (bad @ fires + 4 * START["bad"]) / (bad.sum() + 4)
        rate_good = (good @ fires + 100 * START["good"] / 10) / (good.sum() + 100)
        after = Estimates(
            np.clip(rate_bad, 0.02, 0.98), np.clip(np.minimum(rate_good, rate_bad / 2), 1e-4, 0.2),
            float(np.clip((bad.sum() + 1) / (total + 10), 1e-4, 0.5)),
        )
        moved = np.abs(after.bad - now.bad).max() + np.abs(after.good - now.good).max()
        now = after
        if moved < 1e-7:
            break
    return now


# --- the model -------------------------------------------------------------------------------

@dataclass
class Model:
    learned: frozenset[bytes] = frozenset()
    estimates: dict[str, Estimates] = field(default_factory=dict)
    #: question: (weights of hashed words, weights of votes, constant)
    scorers: dict[str, tuple[np.ndarray, np.ndarray, float]] = field(default_factory=dict)

    def score(self, data: bytes) -> list[float]:
        """Probability to be rejected, by question."""
        vocab = vocabulary(data)
        at = hashed(vocab)
        out = []
        for (question, names), bits in zip(LABELLERS.items(), votes(data, vocab, self.learned)):
            words, vote, constant = self.scorers[question]
            fired = bits >> np.arange(len(names)) & 1
            z = constant + fired @ vote + words[at].sum() / math.sqrt(max(1, len(at)))
            out.append(1 / (1 + math.exp(-min(max(z, -500.0), 500.0))))
        return out

    def scores(self, docs: DataFrame) -> DataFrame:
        """``doc_id junk toxic keep`` of every row of ``docs`` (``doc_id``, ``text``)."""

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = np.array([self.score(t) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array((found < 0.5).all(axis=1))],
                names=["doc_id", "junk", "toxic", "keep"],
            )

        rows = docs.select(F.col("doc_id").cast("long"), "text")
        return arrow_map(rows, run, "doc_id long, junk double, toxic double, keep boolean")

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are not rejected, with all their columns."""

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            good = [max(self.score(t)) < 0.5 for t in utf8(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

        # Names with marks in them do not reach a function.
        at, plain = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        return arrow_map(plain, run, plain.schema).toDF(*docs.columns)


def marking_words(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> frozenset[bytes]:
    """All words that mark the toxic texts among at most ``labelled_rows`` labelled ones."""
    picked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("toxic").cast("int").alias("__toxic")
    ).orderBy(F.xxhash64("__id"), "__id").limit(labelled_rows)
    rows = docs.select("doc_id", "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("__id")  # labelled_rows at most
    ).select("text", "__toxic")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {b"": [0, 0]}
        for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            counts[b""][toxic > 0] += 1
            for word in vocabulary(text):
                counts.setdefault(word, [0, 0])[toxic > 0] += 1
        clean, bad = zip(*counts.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(clean), pa.array(bad)], names=["word", "clean", "bad"]
        )

    counted = arrow_map(rows, run, "word binary, clean long, bad long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("bad").alias("bad")
    )
    all_rows = counted.where(F.length("word") == 0).first()
    if not all_rows or not all_rows["clean"]:
        return frozenset()
    lift = (all_rows["clean"] + 1) / (all_rows["bad"] + 1)
    # Bounded by the texts of the labelled rows.
    found = counted.where(
        (F.length("word") > 0) & (F.col("bad") >= WORD_ROWS) & (F.col("bad") * lift >= WORD_LIFT * (F.col("clean") + 0.5))
    ).select("word").collect()
    return frozenset(bytes(r["word"]) for r in found)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, training_rows: int = TRAINING_ROWS) -> Model:
    """``labelled_rows``: most labelled rows that words are learned from; ``training_rows``: about how many
    documents the scorer is trained on."""
    model = Model(learned=marking_words(docs, labels, labelled_rows))
    learned = model.learned

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for text in utf8(batch.column(0)):
            key = votes(text, vocabulary(text), learned)
            counts[key] = counts.get(key, 0) + 1
        junk, toxic = zip(*counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(junk, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["junk", "toxic", "n"],
        )

    # Two to the number of labellers at most, whatever the number of documents.
    counted = arrow_map(docs.select("text"), count, "junk int, toxic int, n long").groupBy(
        "junk", "toxic"
    ).agg(F.sum("n").alias("n")).orderBy("junk", "toxic").collect()
    n = np.array([r["n"] for r in counted], float)
    for question, names in LABELLERS.items():
        patterns = np.array([r[question] for r in counted], np.int64)
        model.estimates[question] = estimate(patterns, n, len(names))
        vote, constant = model.estimates[question].weights()
        model.scorers[question] = (np.zeros(SIZE, np.float32), vote, constant)
    if n.sum():
        _train(model, docs, n.sum(), training_rows)
    return model


def _train(model: Model, docs: DataFrame, n_docs: float, training_rows: int) -> None:
    """Logistic regression on the posteriors of a sample, from the estimates' weights on."""
    learned = model.learned
    share = min(1.0, training_rows / n_docs)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("text")

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, bits = [], []
        for text in utf8(batch.column(0)):
            vocab = vocabulary(text)
            bits.append(votes(text, vocab, learned))
            at.append(hashed(vocab).astype(np.int32))
        junk, toxic = zip(*bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.list_(pa.int32())), pa.array(junk, pa.int32()), pa.array(toxic, pa.int32())],
            names=["at", "junk", "toxic"],
        )

    # About training_rows rows at any size.
    rows = arrow_map(picked, features, "at array<int>, junk int, toxic int").toArrow()
    lists = rows.column("at").combine_chunks()
    at, starts = lists.flatten().to_numpy(), np.asarray(lists.offsets)
    sizes = np.diff(starts)
    if not len(sizes):
        return
    row = np.repeat(np.arange(len(sizes)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    for question, names in LABELLERS.items():
        fired = (rows.column(question).to_numpy()[:, None] >> np.arange(len(names)) & 1).astype(float)
        vote, constant = model.estimates[question].weights()
        label = 1 / (1 + np.exp(-(fired @ vote + constant)))
        # Part of the votes' weight is left for the words to take over.
        vote, words, bias = VOTE_SHARE * vote, np.zeros(SIZE), VOTE_SHARE * constant
        start, first = vote.copy(), bias
        seen = np.full(SIZE, 1e-6)
        for _ in range(30):
            z = fired @ vote + bias + scale * np.bincount(row, words[at], len(sizes))
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
            slope = np.bincount(at, (off * scale)[row], SIZE) / len(sizes) + 1e-4 * words
            seen += slope * slope
            words -= 0.05 * slope / np.sqrt(seen)
            vote = vote - 0.5 * (fired.T @ off / len(sizes) + 1e-2 * (vote - start))
            bias -= 0.5 * (off.mean() + 1e-2 * (bias - first))
        model.scorers[question] = (words.astype(np.float32), vote, float(bias))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return fit(docs, table(spark, sf_dir, "labels")).scores(docs)
