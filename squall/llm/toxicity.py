"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features are densities of a fixed and of a learned lexicon, how close their
words stand to a second person, capitals, punctuation and obfuscation rates.
The learned lexicon holds words and word beginnings far more frequent in
toxic than in other labelled documents. Lexicon, trees and calibration each
learn from their own share of the labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import arrow_function, column, crc_of, map_arrow, packed, pinned, ship, unpacked
from squall.llm.words import Words, pieces, utf8, words

# Common insults, second-person words, and characters written for letters.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "scum", "clown",
           "pathetic", "worthless", "disgusting", "filthy", "ugly", "jerk", "bastard", "fool", "imbecile", "cretin",
           "dimwit", "pig", "vermin", "garbage", "freak", "creep", "coward", "liar", "hate")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "ti", "tus")
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("log_words", "insult_density", "insults", "learned_density", "learned", "learned_heaviest", "learned_sum",
            "second_person", "near_second_person", "capitals", "capital_words", "punctuation", "exclamations", "symbols",
            "digits", "obfuscated")
NEAR = 5
#: Bounds: labelled rows that are learned from, and terms of the learned lexicon.
MOST_LABELLED = 60_000
MOST_TERMS = 20_000
LEAST_DOCUMENTS = 3
LEAST_ODDS = 2.5
THRESHOLD = 0.7

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
for _from, _to in WRITTEN_FOR.items():
    _LETTERS[ord(_from)] = ord(_to)
_GAP = np.zeros(256, dtype=bool)
_GAP[32] = True
_BYTE = np.zeros((256, 6), dtype=bool)      # letter, capital, punctuation, exclamation, symbol, digit
_BYTE[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)), 0] = True
_BYTE[65:91, 1] = True
_BYTE[[ord(c) for c in ".,;:!?'\"()-"], 2] = True
_BYTE[ord("!"), 3] = True
_BYTE[[ord(c) for c in "#$%&*+/<=>@[]^_`{|}~\\"], 4] = True
_BYTE[48:58, 5] = True


def spelled(texts: pa.Array) -> Words:
    """Words with characters written for letters read as those letters, other signs as gaps."""
    return words(texts, _LETTERS, _GAP)


def _hashes(terms: tuple[str, ...]) -> np.ndarray:
    return np.sort(spelled(pa.array(terms)).hashes)


_INSULTS, _SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)


def _in(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, -1 where absent."""
    if len(known) == 0:
        return np.full(len(value), -1)
    at = np.searchsorted(known, value)
    at[at == len(known)] = 0
    return np.where(known[at] == value, at, -1)


def _rate(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _per_document(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between the places ``at``."""
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def features_of(texts: pa.Array, terms: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text; ``terms`` (sorted hashes) and ``odds`` are the learned lexicon."""
    out = []
    for begin, end in pieces(texts):
        part = texts.slice(begin, end - begin)
        w = spelled(part)
        raw, at = utf8(part)
        n = w.count()
        insult = _in(w.hashes, _INSULTS) >= 0
        weight = np.zeros(len(w.hashes))
        for value in (w.hashes, w.prefix(5), w.prefix(4)):
            found = _in(value, terms)
            if len(terms):
                weight = np.maximum(weight, np.where(found >= 0, odds[found], 0.0))
        learned = weight > 0
        second = _in(w.hashes, _SECOND) >= 0
        bad = insult | learned
        doc = w.doc()
        near = np.zeros(len(w.hashes), dtype=bool)
        for step in range(1, NEAR + 1):
            if len(bad) > step:
                same = doc[step:] == doc[:-step]
                near[step:] |= bad[step:] & second[:-step] & same
                near[:-step] |= bad[:-step] & second[step:] & same
        heaviest = np.zeros(end - begin)
        np.maximum.at(heaviest, doc[learned], weight[learned])
        kinds = _BYTE[raw]
        letters, capitals, marks, shouts, symbols, digits = (_per_document(kinds[:, i], at) for i in range(6))
        first, last = kinds[w.start, 1] if len(raw) else np.zeros(0, bool), w.end - w.start
        caps = np.concatenate([[0], np.cumsum(kinds[:, 1])])
        shouted = (caps[w.end] - caps[w.start] == last) & (last > 1) & first
        # a sign or digit with letters on both sides is an obfuscated letter
        inner = np.zeros(len(raw), dtype=bool)
        if len(raw) > 2:
            inner[1:-1] = (kinds[1:-1, 4] | kinds[1:-1, 5] | kinds[1:-1, 3]) & kinds[:-2, 0] & kinds[2:, 0]
        size = np.diff(at)
        hits, known = _per_document(insult, w.first), _per_document(learned, w.first)
        out.append(np.stack([
            np.log1p(n), _rate(hits, n), np.log1p(hits), _rate(known, n), np.log1p(known), heaviest,
            _per_document(weight, w.first) / np.sqrt(np.maximum(n, 1)), _rate(_per_document(second, w.first), n),
            _rate(_per_document(near, w.first), _per_document(bad, w.first)), _rate(capitals, letters),
            _rate(_per_document(shouted, w.first), n), _rate(marks, size), _rate(shouts, size), _rate(symbols, size),
            _rate(digits, size), _rate(_per_document(inner, at), n)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _arrays(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(rows.ravel()))


def _terms_of(texts: pa.Array, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """How many toxic and other documents hold each word or word beginning."""
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    for begin, end in pieces(texts):
        w = spelled(texts.slice(begin, end - begin))
        doc = w.doc() + begin
        for value in (w.hashes, w.prefix(5), w.prefix(4)):
            ok = value > 0
            pair = np.unique(np.stack([value[ok], doc[ok].astype(np.uint64)], axis=1), axis=0)
            found.append(pair[:, 0])
            owner.append(pair[:, 1].astype(np.int64))
    value = np.concatenate(found) if found else np.zeros(0, np.uint64)
    doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    term, place = np.unique(value, return_inverse=True)
    bad = np.bincount(place, weights=toxic[doc], minlength=len(term)).astype(np.int64)
    return {"term": term.view(np.int64), "toxic": bad, "other": np.bincount(place, minlength=len(term)) - bad}


def learn_lexicon(rows: DataFrame, least: int = LEAST_DOCUMENTS, odds: float = LEAST_ODDS,
                  most: int = MOST_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Terms of rows (text, toxic 0/1): hashes of words and of their first 4 and 5 bytes that at
    least ``least`` toxic documents hold, with smoothed log odds of ``odds`` or more; the
    ``most`` heaviest if more. Returns sorted hashes and their log odds."""
    def count(batches):
        for batch in batches:
            toxic = np.asarray(column(batch, "toxic"), np.float64)
            yield pa.RecordBatch.from_pydict(_terms_of(column(batch, "text"), toxic))

    n = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_other = int(n[0] or 0), int(n[1] or 0)
    counts = map_arrow(rows.select("text", "toxic"), count, "term long, toxic long, other long") \
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (n_other + 1.0))
    top = counts.where(F.col("toxic") >= least).withColumn("odds", weight).where(F.col("odds") >= odds) \
        .orderBy(F.desc("odds"), "term").limit(most).select("term", "odds").collect()
    terms = np.array([r["term"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.array([r["odds"] for r in top], dtype=np.float64)[order]


def add_features(df: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], text: str, name: str) -> DataFrame:
    """``df`` with an array of FEATURES of its text (null and empty texts: of an empty one)."""
    ship(df.sparkSession)
    terms, odds = lexicon

    def features(texts: pa.Array) -> pa.Array:
        return _arrays(features_of(texts, terms, odds))

    return df.withColumn(name, arrow_function(features, "array<double>")(F.col(text)))


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``score`` adds a score column to any table."""

    def __init__(self, lexicon, trees, calibration, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, df: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``df`` with a score from 0 to 1. Equal calibrated values keep the order of the trees'
        own probability, which counts for a thousandth."""
        if self.trees is None:
            return df.withColumn(name, F.lit(self.base))
        made = add_features(df, self.lexicon, text, "_features").withColumn("_vector", array_to_vector("_features"))
        made = self.trees.transform(made).withColumn("_raw", vector_to_array("_probability")[1])
        made = self.calibration.transform(made)
        return made.withColumn(name, 0.999 * F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0))
                               + 0.001 * F.col("_raw")) \
            .drop("_features", "_vector", "_margin", "_probability", "_class", "_raw", "_calibrated")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        most_labelled: int = MOST_LABELLED, rounds: int = 20, depth: int = 3) -> ToxicityModel:
    """Learn from labelled rows whose crc32(key as text) modulo 3 is not 1, at most about
    ``most_labelled`` of them (chosen by a hash of the key).

    Half of them give the lexicon, three tenths the trees, a fifth the calibration. Rows without
    key or label are not learned from; a key labelled twice counts by its larger label. If a share
    lacks one of the two classes, every score is the share of toxic labels."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")) \
        .where("key is not null and toxic in (0, 1)").where(crc_of("key") % 3 != 1) \
        .groupBy("key").agg(F.max("toxic").alias("toxic"))
    have = named.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    base = float(have[1] or 0) / max(1, have[0])
    share = min(1.0, most_labelled / max(1, have[0]))
    pick = F.pmod(F.xxhash64(F.lit("pick"), "key"), F.lit(1_000_000)) < int(share * 1_000_000)
    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(10))
    chosen = named.where(pick).withColumn("part", part)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .join(F.broadcast(chosen), "key")           # at most about most_labelled keys
    rows = pinned(rows.select("text", "toxic", "part"), "toxicity-rows")
    lexicon = learn_lexicon(rows.where("part < 5").select("text", "toxic"))
    made = add_features(rows.where("part >= 5"), lexicon, "text", "features")
    made = pinned(made.select("features", F.col("toxic").cast("double").alias("toxic"), "part"), "toxicity-features") \
        .withColumn("_vector", array_to_vector("features"))
    classes = {(r["trees"], r["toxic"]): r["n"] for r in made.groupBy((F.col("part") < 8).alias("trees"), "toxic")
               .agg(F.count(F.lit(1)).alias("n")).collect()}
    if any((which, kind) not in classes for which in (True, False) for kind in (0.0, 1.0)):
        return ToxicityModel(lexicon, None, None, base)
    learner = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_class", maxIter=rounds,
                            maxDepth=depth, minInstancesPerNode=5, seed=1)
    learner.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    trees = learner.fit(made.where("part < 8").coalesce(4))
    held = trees.transform(made.where("part >= 8")).withColumn("_raw", vector_to_array("_probability")[1])
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_calibrated") \
        .fit(held.select("_raw", "toxic").coalesce(1))
    return ToxicityModel(lexicon, trees, calibration, base)


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD, **options) -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``.

    Only the text makes the score; null and empty texts get that of an empty one. ``held_out`` is
    whether crc32(key as text) modulo 3 is 1 (null keys: false); ``predicted`` is 1 from
    ``threshold`` on. Repeated rows stay repeated."""
    model = fit(docs, labels, key, text, **options)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return model.score(rows).select(
        F.col("key").alias(key), F.coalesce(crc_of("key") % 3 == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under the threshold."""
    model = fit(docs, labels, key, text, **options)
    return unpacked(model.score(packed(docs, text=F.col(text))).where(F.col("score") < threshold))
