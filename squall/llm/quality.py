"""Document quality by hierarchical empirical Bayes: the evidence of a document classifier combined
with posterior quality rates of the document's host and path.

The classifier's probabilities of all documents are summed by host and by
path. A host's posterior rate is drawn towards the global rate, a path's
towards its host's, the more so the fewer documents a site has; how strongly
follows from how much the sites' own rates differ (method of moments). The
score joins the path's posterior as prior odds with the document's likelihood
ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squall.llm.common import arrow_function, crc_of, packed, pinned, ship, unpacked
from squall.llm.words import pieces, utf8, words

FEATURES = ("log_words", "word_bytes", "distinct_words", "log_lines", "repeated_lines", "longest_word", "capitals",
            "symbols", "marks", "exclamations", "bars", "digits", "letters", "sign_words", "short_lines", "top_word")
MOST_LABELLED = 60_000
THRESHOLD = 0.5
#: Evidence of one document is kept within these probabilities.
LEAST, MOST = 0.002, 0.998
STRENGTHS = (1.0, 1e6)

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_KINDS = np.zeros((256, 7), dtype=bool)     # capital, symbol, mark, exclamation, bar, digit, letter
_KINDS[65:91, 0] = True
_KINDS[[ord(c) for c in "#$%&*+/<=>@[]^_{}~\\"], 1] = True
_KINDS[[ord(c) for c in ".,;:?'\"()-"], 2] = True
_KINDS[ord("!"), 3] = True
_KINDS[ord("|"), 4] = True
_KINDS[48:58, 5] = True
_KINDS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)), 6] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: how many values are distinct, and how often the most frequent occurs."""
    distinct, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(value[a:b])
            change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], most[i] = len(change) - 1, np.diff(change).max()
    return distinct, most


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; null and empty texts give zeros."""
    out = []
    for begin, end in pieces(texts):
        part = texts.slice(begin, end - begin)
        raw, at = utf8(part)
        w, lines = words(part), words(part, _AS_IS, _NEWLINE)
        n, n_lines, size = w.count(), lines.count(), np.diff(at)
        few, some, many = np.maximum(n, 1), np.maximum(n_lines, 1), np.maximum(size, 1)
        kinds = _KINDS[raw]
        capitals, symbols, marks, shouts, bars, digits, letters = (_sums(kinds[:, i], at) for i in range(7))
        distinct, top = _repeats(w.hashes, w.first)
        distinct_lines, _ = _repeats(lines.hashes, lines.first)
        length = w.end - w.start
        longest = np.zeros(end - begin)
        np.maximum.at(longest, w.doc(), length)
        last = np.maximum(w.end - 1, 0)
        signs = kinds[last, 1] | kinds[last, 3] | kinds[last, 4] if len(raw) else np.zeros(0, bool)
        out.append(np.stack([
            np.log1p(n), _sums(length, w.first) / few, distinct / few, np.log1p(n_lines), 1 - distinct_lines / some,
            np.log1p(longest), capitals / np.maximum(letters, 1), symbols / many, marks / many, shouts / many,
            bars / many, digits / many, letters / many, _sums(signs, w.first) / few,
            _sums(lines.end - lines.start < 30, lines.first) / some, top / few], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _feature_column(text: str) -> Column:
    def features(texts: pa.Array) -> pa.Array:
        rows = features_of(texts)
        n, k = rows.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(rows.ravel()))

    return arrow_function(features, "array<double>")(F.col(text))


class Classifier:
    """Probability that a document is good, from its text alone. Without trees it is the base rate."""

    def __init__(self, trees, base: float):
        self.trees, self.base = trees, base

    def add(self, df: DataFrame, text: str, name: str) -> DataFrame:
        if self.trees is None:
            return df.withColumn(name, F.lit(self.base))
        ship(df.sparkSession)
        made = df.withColumn("_features", _feature_column(text)).withColumn("_vector", array_to_vector("_features"))
        made = self.trees.transform(made).withColumn(name, vector_to_array("_probability")[1])
        return made.drop("_features", "_vector", "_margin", "_probability", "_class")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        most_labelled: int = MOST_LABELLED, rounds: int = 20, depth: int = 3) -> Classifier:
    """Boosted trees over FEATURES, learned from labelled rows whose crc32(key as text) modulo 3 is
    not 1, at most about ``most_labelled`` of them by a hash of the key. A key labelled twice
    counts by its smaller label; with one class only, the classifier is the base rate."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("good")) \
        .where("key is not null and good in (0, 1)").where(crc_of("key") % 3 != 1) \
        .groupBy("key").agg(F.min("good").alias("good"))
    n, good = named.agg(F.count(F.lit(1)), F.sum("good")).first()
    base = (float(good or 0) + 0.5) / (n + 1.0)
    if not n or good in (0, n):
        return Classifier(None, base)
    share = int(min(1.0, most_labelled / n) * 1_000_000)
    chosen = named.where(F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(1_000_000)) < share)
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key") \
        .select(_feature_column("text").alias("features"), F.col("good").cast("double").alias("good"))
    rows = pinned(rows, "quality-features").withColumn("_vector", array_to_vector("features"))
    seen = {r["good"] for r in rows.select("good").distinct().collect()}
    if len(seen) < 2:
        return Classifier(None, base)
    learner = GBTClassifier(featuresCol="_vector", labelCol="good", predictionCol="_class", maxIter=rounds,
                            maxDepth=depth, minInstancesPerNode=5, seed=1)
    learner.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    return Classifier(learner.fit(rows.coalesce(4)), base)


def _site(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _strength(rows: DataFrame, total: str, n: str, towards: str) -> float:
    """How many documents the upper level's rate weighs as, by the method of moments: from the
    spread of site rates around it beyond what their numbers of documents explain."""
    rate = F.col(total) / F.col(n)
    expected = F.col(towards) * (1 - F.col(towards))
    got = rows.agg(F.sum(F.col(n) * (rate - F.col(towards)) ** 2).alias("spread"), F.sum(expected).alias("noise"),
                   F.sum(F.col(n) * expected).alias("scale"), F.sum(n).alias("n")).first()
    between = ((got["spread"] or 0.0) - (got["noise"] or 0.0)) / max(1.0, float(got["n"] or 0))
    within = (got["scale"] or 0.0) / max(1.0, float(got["n"] or 0))
    if between <= 0 or within <= 0:
        return STRENGTHS[1]
    return float(min(max(within / between - 1, STRENGTHS[0]), STRENGTHS[1]))


def site_rates(rows: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate) from rows (host, path, evidence): grouped sums, shrunk
    level by level. The sums are partly made before the shuffle, so a hot host costs no more."""
    paths = pinned(rows.groupBy("host", "path").agg(F.sum("evidence").alias("good"), F.count(F.lit(1)).alias("n")),
                   "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    overall = float(total[0] / total[1]) if total[1] else 0.5
    hosts = hosts.withColumn("overall", F.lit(overall))
    k = _strength(hosts, "good", "n", "overall")
    hosts = hosts.select("host", ((F.col("good") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = _strength(paths, "good", "n", "host_rate")
    return paths.select("host", "path", "host_rate",
                        ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def _logit(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(LEAST)), F.lit(MOST))
    return F.log(kept / (1 - kept))


def _joined(evidence: str, rate: str, base: float) -> Column:
    """Posterior probability from prior odds ``rate`` and the evidence's likelihood ratio."""
    odds = _logit(F.col(evidence)) - float(np.log(base / (1 - base))) + _logit(F.col(rate))
    return 1 / (1 + F.exp(-odds))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                   path: str = "lang", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(key, held_out, evidence, host_rate, path_rate, score, predicted) of every row of ``docs``.

    ``evidence`` is the classifier's probability of a good document, ``score`` the posterior one,
    ``predicted`` 1 from ``threshold`` on. Null hosts and paths count as empty ones; null or empty
    texts have the evidence of an empty one; repeated rows each count. ``held_out`` rows (crc32 of
    the key as text modulo 3 is 1) gave no label."""
    model = fit(docs, labels, key, text, **options)
    rows = model.add(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _site(host).alias("host"),
                                 _site(path).alias("path")), "text", "evidence").drop("text")
    rows = pinned(rows, "quality-evidence")
    return rows.join(site_rates(rows), ["host", "path"]).select(
        F.col("key").alias(key), F.coalesce(crc_of("key") % 3 == 1, F.lit(False)).alias("held_out"), "evidence",
        "host_rate", "path_rate", _joined("evidence", "path_rate", model.base).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
              path: str = "lang", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    model = fit(docs, labels, key, text, **options)
    marked = model.add(packed(docs, text=F.col(text), host=_site(host), path=_site(path)), "text", "evidence")
    rates = site_rates(marked.select("host", "path", "evidence"))
    return unpacked(marked.join(rates, ["host", "path"]).where(_joined("evidence", "path_rate", model.base) >= threshold))
