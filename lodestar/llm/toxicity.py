"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a lexicon, how near its words stand to
words for the second person, and rates of capitals, punctuation and obfuscation.
Null and empty texts get the score of a text without any feature.
The lexicon holds words, and beginnings of words, that stand in far more toxic
than other documents of the sample.  Trees and calibration are fitted on parts
of the sample that do not overlap.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.rows import add_column
from lodestar.llm.shared import settle

#: Labelled rows that the lexicon, the trees and the calibration are fitted on, at most (about); they bound the lexicon too.
SAMPLE = 12_000
#: Letters of a beginning.
BEGINNING = 5
#: A learned entry stands in this many toxic documents at least, and exceeds what its frequency lets expect by so many standard deviations.
LEAST_TOXIC, DEVIATIONS = 4, 3.5
#: The odds of toxic against other documents with a learned entry are this many times those of all documents at least.
LIFT = 4
#: Share of the sample kept for calibration.
CALIBRATION = 0.25
#: Trees and their depth.
TREES, DEPTH = 15, 3

#: Insults in four languages, used besides what is learned.
INSULTS = frozenset("""
idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb fool imbecile retard bastard bitch whore slut asshole jerk vermin filth
dumm dummkopf arschloch trottel depp abschaum versager hurensohn ekelhaft
imbécile connard connasse salaud salope débile ordure minable dégoûtant
idiota estúpido estúpida imbécil basura escoria asqueroso asquerosa cabrón perdedor patético
""".split())
#: Words for the second person.
YOU = frozenset("""
you your yours yourself yourselves u ur ya du dich dir dein deine deiner deinem deinen ihr euch euer eure
tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra
""".split())

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
#: A token with a sign or figure that stands for letters; possessive, so that a long token is read once.
SIGNED = re.compile(r"(?<!\S)[^\s0-9@$!*#+]*+[0-9@$!*#+]\S*+")
LETTER, DISGUISE = re.compile("[A-Za-z]"), re.compile("[A-Za-z0-9@$!*#+]")
SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?![^\W\d_])")
LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
LEET = str.maketrans("01345789@$!+|", "oieastbgasitl")
NAMES = ("words", "insults", "insult_rate", "learned", "learned_rate", "learned_kinds", "weight", "beginnings", "beginning_rate", "near_you", "you_rate", "capitals", "shouted", "marks", "exclamations", "obfuscated", "obfuscated_hits", "long_runs")


def lexicon_counts(texts: DataFrame) -> DataFrame:
    """entry, toxic, other: in how many toxic and other documents of texts(text, label) each word or beginning stands."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{2,}+"), F.lit(0)))
    starts = F.array_distinct(F.transform(F.filter("words", lambda w: F.char_length(w) > BEGINNING), lambda w: F.concat(F.substring(w, 1, BEGINNING), F.lit("*"))))
    entries = texts.select("label", words.alias("words")).select("label", F.explode(F.concat("words", starts)).alias("entry"))
    return entries.groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Weight, a log ratio of document frequencies, of each entry. The sample bounds how many come to the driver: each stands in LEAST_TOXIC or more of its documents."""
    total = texts.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    if not total.n or not total.toxic or total.toxic == total.n:
        return {}
    rate = total.toxic / total.n
    expected = (F.col("toxic") + F.col("other")) * rate
    # both can be reached at any share of toxic labels
    unlikely = F.col("toxic") - expected >= DEVIATIONS * F.sqrt(expected * (1 - rate) + 1)
    sure = (F.col("toxic") >= LEAST_TOXIC) & unlikely & ((F.col("toxic") + 0.5) / (F.col("other") + 0.5) >= LIFT * rate / (1 - rate))
    found = lexicon_counts(texts).where(sure).collect()
    clean = total.n - total.toxic
    return {r.entry: min(8.0, math.log((r.toxic + 0.5) / (total.toxic + 1)) - math.log((r.other + 0.5) / (clean + 1))) for r in found}


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """The values of NAMES; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(NAMES)
    low = text.lower()
    words = WORD.findall(low)
    n = len(words) or 1
    insults = learned_hits = beginnings = you = 0
    weight, kinds, last_you, last_hit, near = 0.0, set(), -1000, -1000, 1000
    get = learned.get
    for at, w in enumerate(words):
        if w in YOU:
            you += 1
            last_you = at
            near = min(near, at - last_hit)
        known = get(w)
        hit = w in INSULTS
        insults += hit
        if known is not None:
            learned_hits += 1
            weight += known
            kinds.add(w)
            hit = True
        if len(w) > BEGINNING:
            known = get(w[:BEGINNING] + "*")
            if known is not None:
                beginnings += 1
                weight += known
                hit = True
        if hit:
            last_hit = at
            near = min(near, at - last_you)
    odd = hidden = 0
    if not low.isalpha():
        for m in SIGNED.findall(low):
            # a letter after the first letter or sign
            if not LETTER.search(m, DISGUISE.search(m).end()):
                continue
            odd += 1
            plain = "".join(WORD.findall(m.translate(LEET)))
            hidden += plain in INSULTS or plain in learned
        for m in SPELLED.findall(low):
            odd += 1
            plain = "".join(WORD.findall(m))
            hidden += plain in INSULTS or plain in learned
    size = len(text)
    capitals = size - len(text.translate(_NO_CAPITALS))
    shouted = len(_SHOUT.findall(text))
    marks = size - len(text.translate(_NO_MARKS))
    return [
        math.log1p(len(words)), float(insults), insults / n, float(learned_hits), learned_hits / n, float(len(kinds)), weight, float(beginnings), beginnings / n,
        float(min(near, 50)) if insults + learned_hits + beginnings else 51.0, you / n, capitals / size, shouted / n, marks / size, text.count("!") / n, odd / n, float(hidden), len(LONG_RUN.findall(low)) / n,
    ]


_NO_CAPITALS = {ord(c): None for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ"}
_NO_MARKS = {ord(c): None for c in "!?.,;:'\"()*#$%&@"}
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")


def with_features(docs: DataFrame, learned: dict[str, float], text_col: str) -> DataFrame:
    """docs with the array features."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def start():
        known = sent.value
        return lambda text: features(text, known)

    return add_column(docs, [text_col], "features", "array<double>", start)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    """A lexicon, trees and calibration, fitted on labelled documents.

    Labels come only from rows that are not held out; of those about sample rows,
    chosen by a hash of their ids, are fitted on.  Null labels are left out; an id
    labelled twice counts with its larger label.  Without labels of both kinds
    every score is the share of label 1, or 0 where there are none.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
        self.id_col, self.text_col, self.learned, self.trees, self.steps = id_col, text_col, {}, None, None
        picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
        known = labels.where(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
        n = known.count()
        drawn = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
        # about sample rows of two numbers
        texts = settle(picked.join(F.broadcast(drawn), "doc_id"), "toxicity-sample")
        fit_on = texts.where(_fit_part())
        counts = fit_on.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
        self.share = float(counts.toxic) / counts.n if counts.n else 0.0
        if not counts.n or counts.toxic in (0, counts.n):
            return
        self.learned = learn_lexicon(fit_on)
        self._fit(settle(with_features(texts, self.learned, "text").select("doc_id", "features", "label").coalesce(4), "toxicity-fit"))

    def _fit(self, sample: DataFrame) -> None:
        trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=3, seed=5, maxMemoryInMB=64)
        self.trees = trees.fit(_vector(sample.where(_fit_part())).coalesce(4))
        judged = settle(self._raw(sample.where(~_fit_part())).select("p", "label"), "toxicity-calibration")
        kinds = judged.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
        if kinds.low is not None and kinds.low != kinds.high:
            self.steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(judged)

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(_vector(rows)).withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score, 0 to 1; no row leaves its partition. Null text: empty."""
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.share))
        rows = self._raw(with_features(docs, self.learned, self.text_col)).drop("features")
        if self.steps is not None:
            # a little of the uncalibrated value keeps the order within a step
            rows = self.steps.transform(rows).withColumn("p", F.col("calibrated") * 0.98 + F.col("p") * 0.02).drop("calibrated")
        return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))).drop("p")


def _fit_part() -> F.Column:
    """Rows for trees and lexicon; the others are for calibration."""
    return F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1000)) >= int(CALIBRATION * 1000)


def _vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", array_to_vector("features"))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs. See Scorer."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = Scorer(docs, labels, id_col=id_col, text_col=text_col, sample=sample).score(picked.withColumnRenamed("text", text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all columns, whatever their names.

    Null and empty texts stay unless the empty text itself is predicted toxic;
    repeated rows share their score and so their fate.  An empty table stays empty.
    """
    bare = docs.withColumnsRenamed({c: f"_{n}" for n, c in enumerate(docs.columns)})
    at = docs.columns.index(text_col)
    scored = Scorer(docs, labels, id_col=id_col, text_col=text_col).score(bare.withColumnRenamed(f"_{at}", text_col))
    return scored.where("score < 0.5").withColumnRenamed(text_col, f"_{at}").select(*[F.col(f"_{n}").alias(c) for n, c in enumerate(docs.columns)])
