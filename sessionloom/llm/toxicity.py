"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words and word beginnings of four
and five letters that stand in toxic documents much more often than in others.
Features are densities of lexicon words, their nearness to second-person
pronouns, capitals, punctuation and obfuscated spelling.  Trees are fitted on
three quarters of the labelled sample and calibrated on the rest.

At most ``MOST_LABELLED`` labelled rows, first by a hash of the id, are used
for fitting; everything is scored.

Defined cases: null and blank texts have all features zero and get a score
like any other; a label above 0 is toxic and any other is not, of several
labels of a document the largest counts; labels that are null or of no document
are left out; repeated rows are scored each and fitted once; with fewer than
two labels of either kind nothing can be learned: every score is then the
smoothed share of toxic labels (0 without any), and ``without_toxic`` keeps
every document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import crc_mod, dropped, stored, table, tune

MOST_LABELLED = 20_000
#: Entries of the learned lexicon, and the least share of toxic documents that hold one.
LEXICON, SUPPORT = 200, 0.02
#: Second-person pronouns of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " .,;:!?\"'()[]{}<>|*#$%&-_/\\"
OBFUSCATED = re.compile(r"[^\W\d_][*@$!#%&0-9]+[^\W\d_]")
STRETCHED = re.compile(r"(.)\1\1")
FEATURES = 14


def terms(word: str) -> tuple[str, ...]:
    """A word as the lexicon knows it: itself and its beginnings."""
    return (word,) if len(word) < 5 else ("4" + word[:4], word) if len(word) == 5 else ("4" + word[:4], "5" + word[:5], word)


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    raw = WORD.findall(text or "")
    if not raw:
        return [0.0] * FEATURES
    n = len(raw)
    plain = [w.strip(STRIP).lower() for w in raw]
    get = lexicon.get
    weight = {w: max((get(t, 0.0) for t in terms(w)), default=0.0) for w in {*plain}}
    hits = [i for i, w in enumerate(plain) if weight[w] > 0]
    second = [i for i, w in enumerate(plain) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        s = np.array(second)
        at = np.searchsorted(s, hits)
        for h, k in zip(hits, at):
            near += any(0 <= j < len(s) and abs(int(s[j]) - h) <= NEAR for j in (k - 1, k))
    letters = sum(c.isalpha() for c in text) or 1
    capitals = sum(c.isupper() for c in text)
    marks = text.count("!") + text.count("?")
    symbols = sum(text.count(c) for c in "#*$%&@|<>")
    weights = [weight[plain[i]] for i in hits]
    return [
        float(np.log1p(n)), max(weights, default=0.0), sum(weights) / n, float(len(hits)), len(hits) / n, float(len({plain[i] for i in hits})),
        near / n, near / max(len(hits), 1), len(second) / n, capitals / letters, marks / n, symbols / n,
        sum(bool(OBFUSCATED.search(w)) for w in {*raw}) / n, sum(bool(STRETCHED.search(w)) for w in {*plain}) / n,
    ]


def term_counts(sample: DataFrame) -> DataFrame:
    """sample(text, toxic) -> (term, toxic, clean): documents that hold each term; summed within the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = [*{**seen[0], **seen[1]}]
            cols = [pa.array(keys, pa.string()), *(pa.array([seen[k][t] for t in keys], pa.int64()) for k in (1, 0))]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["term", "toxic", "clean"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w.strip(STRIP).lower() for w in WORD.findall(text or "")} - {""}
                seen[int(toxic)].update({t for w in words for t in terms(w)})
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    rows = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """The LEXICON terms that tell most (likelihood ratio), with their log odds."""
    a, b = F.col("toxic"), F.col("clean")
    log_odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    rows = (
        term_counts(sample).where(a >= max(2, SUPPORT * toxic)).withColumn("w", log_odds).where("w > 1")
        .orderBy((a * F.col("w") - b).desc(), "term").limit(LEXICON).collect()
    )
    return {r["term"]: r["w"] for r in rows}


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """docs(text, ...kept columns) -> kept columns and ``features``; ``keep`` is their schema, text first in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x, lexicon) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names[1:], "features"])

    tune(docs.sparkSession)
    return docs.mapInArrow(run, f"{keep}, features array<double>")


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, most: int = MOST_LABELLED) -> DataFrame:
    """Different labelled documents (doc_id, text, toxic): ``most`` at most, first by hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # Of rows with one id, the text of least hash.
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "toxic")


class Toxicity:
    """A lexicon, trees and a calibration; or a constant, where the labels teach nothing."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, featured: DataFrame) -> DataFrame:
        """+ score: the calibrated probability; a thousandth of it keeps the trees' order within steps."""
        if self.trees is None:
            return featured.drop("features").withColumn("score", F.lit(self.constant))
        d = self.trees.transform(featured.withColumn("features", array_to_vector("features")))
        d = d.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        d = self.calibration.transform(d)
        out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("prediction") + 0.001 * F.col("raw")))
        return d.withColumn("score", out).drop("raw", "prediction")


def train(sample: DataFrame) -> Toxicity:
    """sample(doc_id, text, toxic), of bounded size, -> the model."""
    over: list[str] = []
    sample = stored(sample, "labelled", over)
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if min(toxic, clean) < 2:
        dropped(over)
        return Toxicity({}, constant=(toxic + 0.5) / (toxic + clean + 1) if toxic else 0.0)
    lexicon = learn_lexicon(sample, toxic, clean)
    rows = stored(with_features(sample.select("text", "doc_id", F.col("toxic").cast("double").alias("label")), lexicon, "doc_id long, label double"), "features", over)
    rows = rows.withColumn("features", array_to_vector("features"))
    fitted = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) != 0
    part, rest = rows.where(fitted), rows.where(~fitted)
    if part.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        part = rest = rows
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, seed=11, subsamplingRate=1.0).fit(part)
    raw = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    dropped(over)
    return Toxicity(lexicon, trees, calibration)


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score)."""
    return model.score(with_features(docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")), model.lexicon, "doc_id long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_sample(docs, labels, crc_mod(F.col("doc_id"), 4) != 2))
    out = score_documents(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, columns unchanged; all of them where the labels teach nothing."""
    names = docs.columns
    model = train(labelled_sample(docs, labels, F.lit(True)))
    if model.trees is None:
        return docs
    whole = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*names).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x, model_lexicon) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["_row", "features"])

    model_lexicon = model.lexicon
    tune(docs.sparkSession)
    featured = whole.mapInArrow(run, f"_row {docs.schema.simpleString()}, features array<double>")
    return model.score(featured).where(F.col("score") < threshold).select("_row.*")
