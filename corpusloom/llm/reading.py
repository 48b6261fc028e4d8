"""Reading level of documents (problem 10): a Rasch-style model of documents' levels and words' difficulties.

In a document of level t, word w occurs at a rate proportional to exp(a_w + b_w t): b_w is the word's difficulty, and
the odds of two words depend on the document's level through the difference of their difficulties only. Levels and
difficulties are estimated in turn from labelled documents: words given levels (a regularised Poisson regression for
each word, in parallel over the words), then levels given words (the mode under a prior at the label's level, in
parallel over the documents). With the words fixed, every other document's level is a one-dimensional mode that
depends on its mean difficulty alone, so all documents are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

BANDS = {"plain": -1.0, "general": 0.0, "demanding": 1.0}
#: At most so many labelled documents are used, the first by a hash of their id; this bounds the model's words too.
LABELLED = 20_000
#: Rounds of the alternation; spread of levels within a band; strength of the prior on difficulties.
ROUNDS, SPREAD, RIDGE = 3, 0.3, 1.0
GRID = np.linspace(-3, 3, 121)
#: A document shorter than this many known words is not called demanding.
LEAST_WORDS = 5

_WORD = re.compile(r"[^\W\d_]+")

# Frequent words of each language that the others lack.
LANGUAGE_WORDS = {
    "en": frozenset("the of and to is are was will be for that with on at by not this from have has you your it as or if can all any shall may".split()),
    "es": frozenset("el los las del y que en por para con una un su al es lo como más se esta cada sobre deben".split()),
    "fr": frozenset("le les des du et est une dans pour que qui sur au aux par avec ce cette ou ne pas sont leur doivent".split()),
}


def is_english(lang: str | None, words: list[str]) -> bool:
    """By the language given, however spelled, else by which language's frequent words prevail."""
    if isinstance(lang, str) and lang.strip():
        return lang.strip().lower().replace("_", "-").split("-")[0] in ("en", "eng", "english")
    counts = Counter(words)
    votes = {k: sum(counts[w] for w in known) for k, known in LANGUAGE_WORDS.items()}
    return votes["en"] > max(votes["es"], votes["fr"])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def _occurrences(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, band, word, n) of at most ``limit`` labelled English documents."""
    labels = labels.where(F.col("reading_band").isin(*BANDS)).select("doc_id", "reading_band").dropDuplicates(["doc_id"])
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, band, lang, text in zip(batch["doc_id"], batch["reading_band"], batch["lang"], batch["text"], strict=True):
                words = words_of(text)
                if is_english(lang, words):
                    rows += [(key, band, w, n) for w, n in Counter(words).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "band", "word", "n"])

    met = documents.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return materialize(met.select("doc_id", "reading_band", "lang", "text").mapInPandas(run, f"doc_id {kind}, band string, word string, n bigint"))


def _fit_words(occurrences: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows (word, a, b) given the documents' levels (doc_id, level)."""
    met = occurrences.join(levels.select("doc_id", "level"), "doc_id")
    cell = F.least(F.greatest(F.round((F.col("level") + 3) / 0.05), F.lit(0)), F.lit(len(GRID) - 1)).cast("int")
    weights = np.zeros(len(GRID))
    for row in met.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect():  # at most one row per grid point
        weights[row["cell"]] = row["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, s = batch["n"].to_numpy(float), batch["s"].to_numpy(float)
            a, b = np.log(n / weights.sum()), np.zeros(len(n))
            for _ in range(25):
                rate = weights * np.exp(a[:, None] + b[:, None] * GRID)
                m0, m1, m2 = rate.sum(1), rate @ GRID, rate @ GRID**2
                g0, g1, h11 = n - m0, s - m1 - RIDGE * b, m2 + RIDGE
                det = np.maximum(m0 * h11 - m1 * m1, 1e-12)
                a += np.clip((h11 * g0 - m1 * g1) / det, -1, 1)
                b += np.clip((m0 * g1 - m1 * g0) / det, -1, 1)
            yield pd.DataFrame({"word": batch["word"], "a": a, "b": b})

    sums = met.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("level")).alias("s"))
    return materialize(sums.mapInPandas(run, "word string, a double, b double"))


def _normaliser(words: DataFrame) -> np.ndarray:
    """The logarithm of the words' total rate at each grid point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(GRID))
        for batch in batches:
            total += np.exp(batch["a"].to_numpy()[:, None] + batch["b"].to_numpy()[:, None] * GRID).sum(0)
        yield pd.DataFrame({"cell": np.arange(len(GRID)), "total": total})

    total = np.zeros(len(GRID))
    for row in words.mapInPandas(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        total[row["cell"]] = row["total"]
    return np.log(np.maximum(total, 1e-300))


def _fit_levels(occurrences: DataFrame, words: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, float, float]]:
    """(rows (doc_id, band, mean, level) given the words, the scale): levels are scaled so that the outer bands' means are -1 and 1."""
    spend = _normaliser(words)
    sums = occurrences.join(words, "word").groupBy("doc_id", "band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("b")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, s, centre = batch["n"].to_numpy(float)[:, None], batch["s"].to_numpy(float)[:, None], batch["band"].map(BANDS).to_numpy(float)[:, None]
            best = np.argmax(s * GRID - n * spend - (GRID - centre) ** 2 / (2 * SPREAD**2), axis=1)
            yield batch.assign(mean=batch["s"] / batch["n"], level=GRID[best])[["doc_id", "band", "mean", "level"]]

    kind = occurrences.schema["doc_id"].dataType.simpleString()
    levels = materialize(sums.mapInPandas(run, f"doc_id {kind}, band string, mean double, level double"))
    means = {r["band"]: r["m"] for r in levels.groupBy("band").agg(F.avg("level").alias("m")).collect()}
    low, high = means.get("plain", -1.0), means.get("demanding", 1.0)
    if high - low < 1e-6:
        low, high = -1.0, 1.0
    return levels.withColumn("level", (F.col("level") - low) * (2 / (high - low)) - 1), (spend, low, high)


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[dict[str, float], float, tuple[np.ndarray, float, float]]:
    """(difficulty of each word, the mean difficulty from which a document is demanding, the latent scale).

    ``documents`` has (doc_id, lang, text), ``labels`` (doc_id, reading_band). The scale is the words' total rate at
    each grid point and the levels that become -1 and 1, the means of the outer bands. All results are bounded by
    ``limit`` documents. Without labelled documents of the band demanding nothing is demanding.
    """
    seen = _occurrences(documents, labels, limit)
    levels = seen.select("doc_id", "band").distinct().withColumn("level", F.coalesce(*[F.when(F.col("band") == k, F.lit(v)) for k, v in BANDS.items()]))
    words = _fit_words(seen, levels)
    for _ in range(ROUNDS):
        levels, _ = _fit_levels(seen, words)
        words = _fit_words(seen, levels)
    levels, scale = _fit_levels(seen, words)
    found = levels.select("mean", (F.col("band") == "demanding").alias("hard")).toPandas()  # at most ``limit`` rows
    return {r["word"]: r["b"] for r in words.select("word", "b").collect()}, _cut(found), scale


def _cut(found: pd.DataFrame) -> float:
    """The mean difficulty that parts demanding documents from others with fewest errors; in a wide gap, its middle."""
    found = found.sort_values("mean", kind="stable")
    hard, means = found["hard"].to_numpy(bool), found["mean"].to_numpy(float)
    if not hard.any():
        return float("inf")
    errors = np.concatenate([[0], np.cumsum(hard)]) + np.concatenate([np.cumsum(~hard[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[means[0] - 1], (means[1:] + means[:-1]) / 2, [means[-1] + 1]])
    widths = np.concatenate([[0], means[1:] - means[:-1], [0]])
    return float(edges[best[np.argmax(widths[best])]])


def score(documents: DataFrame, difficulty: dict[str, float], cut: float, scale: tuple[np.ndarray, float, float] | None = None) -> DataFrame:
    """Rows (doc_id, words, difficulty, level, demanding) of each English document with a text.

    ``words`` are its known words, ``difficulty`` their mean, null without any, and ``level`` its place on the latent
    scale (plain about -1, general 0, demanding 1), which a document of few known words hardly leaves the middle of;
    null without a scale. Below LEAST_WORDS nothing is demanding. All documents are scored where they lie; only the
    short results of repeated deliveries are dropped by a shuffle.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((difficulty, scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, scale = shared.value
        for batch in batches:
            rows = []
            for key, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                words = words_of(text)
                if words and is_english(lang, words):
                    met = [known[w] for w in words if w in known]
                    rows.append((key, len(met), sum(met)))
            out = pd.DataFrame(rows, columns=["doc_id", "words", "sum"])
            n, s = out["words"].to_numpy(float), out["sum"].to_numpy(float)
            mean = np.divide(s, n, out=np.full(len(n), np.nan), where=n > 0)
            level: np.ndarray | None = None
            if scale is not None and len(out):
                spend, low, high = scale
                best = np.argmax(s[:, None] * GRID - n[:, None] * spend - GRID**2 / 2, axis=1)
                level = (GRID[best] - low) * (2 / (high - low)) - 1
            yield pd.DataFrame({"doc_id": out["doc_id"], "words": out["words"], "difficulty": pd.array(mean, "Float64") if len(out) else [], "level": level if level is not None else [None] * len(out), "demanding": (n >= LEAST_WORDS) & (mean > cut)})

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "lang", "text").mapInPandas(run, f"doc_id {kind}, words int, difficulty double, level double, demanding boolean")
    return scored.withColumn("difficulty", F.when(F.col("words") > 0, F.col("difficulty"))).distinct()
