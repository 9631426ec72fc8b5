"""Language identification by nearest centroids of TF-IDF vectors of letter n-grams.

Each language has several centroids, found by spherical k-means, since its texts come in
kinds. A text gets the language of the centroid with the largest cosine; one too far from it, by
the radius that this centroid has for texts with as many distinct n-grams, is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import parts
from .sampling import thinned

UNKNOWN = "und"
#: Hashed features of a vector.
FEATURES = 1 << 13
#: Documents that a language's centroids are fitted on at most; document frequencies come from all.
PER_LANGUAGE = 400
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below this share of the cosine that all but one in a hundred held-out texts of its size have.
#: On the given tables 0.4 to 0.45 rejects no text of a right language, and all foreign and random ones of tests/llm.
RADIUS = 0.45
#: Radii are measured at 2**_SIZES distinct n-grams, since cosines grow with them, and are a centroid's own from so many texts.
_SIZES, OWN_TEXTS = np.arange(3, 14), 50
MAX_LANGUAGES = 1000
_BATCH = 256


class Model(NamedTuple):
    """``languages`` and ``least`` (smallest accepted cosine at each size) of each row of ``centroids``; ``idf`` of each feature."""

    languages: list[str]
    least: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 2- and 3-grams of lower-case letters, words one space apart; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    before = np.concatenate(([False], letter[:-1]))
    points = np.where(letter, points, np.uint32(32))[letter | before]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)])).astype(np.uint32)
    pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
    return np.bincount(np.concatenate((pairs >> np.uint32(19), triples >> np.uint32(19))), minlength=FEATURES)


def vectors(counts: list[np.ndarray | None], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a zero row for None."""
    out = np.zeros((len(counts), FEATURES), np.float32)
    for k, count in enumerate(counts):
        if count is not None:
            out[k] = np.log1p(count)
    out *= idf
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of labelled documents (``doc_id``, ``text``, ``lang``); those without label or letter teach nothing.

    Document frequencies are counted over all of them. Centroids are fitted on at most ``per_language``
    different documents of each language, those with the smallest hashes of doc_id and text. More than ``MAX_LANGUAGES``
    different labels are an error. Rows that repeat a doc_id are documents of their own; rows that also repeat its text
    count for the frequencies each, but are one document of the sample. An empty table gives a model without languages.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    frequency = np.zeros(FEATURES)
    total = 0
    for row in _document_frequency(labelled.select("text")).collect():  # one row for each feature
        if row["feature"] < 0:
            total = row["n"]
        else:
            frequency[row["feature"]] = row["n"]
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)

    sample = sampled(docs, per_language)

    def cluster(texts: pd.DataFrame) -> pd.DataFrame:
        known = [t for t in texts["text"] if ngram_counts(t) is not None]
        known.sort(key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t))  # rows come in any order
        rows = vectors([ngram_counts(t) for t in known], idf)
        centroids = spherical_kmeans(rows, CENTROIDS)
        least, lang = RADIUS * radii(known, rows, centroids, idf), texts["lang"].iloc[0]
        return pd.DataFrame(
            {
                "lang": pd.Series([lang] * len(least), dtype=object),
                "least": pd.Series(list(least), dtype=object),
                "centroid": pd.Series([c.tobytes() for c in centroids], dtype=object),
            }
        )

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, least array<double>, centroid binary")
    # At most CENTROIDS rows of each language.
    rows = sorted(found.collect(), key=lambda r: (r["lang"], bytes(r["centroid"])))
    centroids = [np.frombuffer(bytes(r["centroid"]), np.float32) for r in rows]
    return Model(
        [r["lang"] for r in rows],
        np.array([r["least"] for r in rows], np.float64).reshape(len(rows), len(_SIZES)),
        np.array(centroids, np.float32).reshape(len(rows), FEATURES),
        idf,
    )


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """``lang`` and ``text`` of at most ``per_language`` different labelled documents of each language."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("key"), "lang", "text")
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Bounded by MAX_LANGUAGES rows.
    counts = F.broadcast(docs.sparkSession.createDataFrame(counted, "counted string, n bigint"))
    many = labelled.select("key", "lang").join(counts, F.col("lang") == F.col("counted"))
    chosen = thinned(many, 2 * per_language / F.col("n"), "key").select("key", "lang").distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = chosen.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_language)
    # At most per_language keys of each language, and languages are few. Rows that repeat one are one.
    few = F.broadcast(chosen.select(F.col("key").alias("k"), F.col("lang").alias("own")))
    found = labelled.join(few, (F.col("key") == F.col("k")) & (F.col("lang") == F.col("own")))
    return found.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")


def _document_frequency(texts: DataFrame) -> DataFrame:
    """``feature`` and ``n``, its documents; feature -1 is the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, total = np.zeros(FEATURES, np.int64), 0
        for batch in parts(batches):
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    frequency += counts > 0
                    total += 1
        features = np.concatenate(([-1], np.flatnonzero(frequency)))
        numbers = np.concatenate(([total], frequency[frequency > 0]))
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(numbers, pa.int64())], ["feature", "n"])

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit rows. Begins with evenly spaced rows."""
    if not len(rows):
        return np.empty((0, FEATURES), np.float32)
    centroids = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        owner = (rows @ centroids.T).argmax(axis=1)
        owned = np.unique(owner)
        sums = np.stack([rows[owner == c].sum(axis=0) for c in owned])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    kept = np.unique((rows @ centroids.T).argmax(axis=1))
    return centroids[kept].astype(np.float32)


def radii(texts: list[str], rows: np.ndarray, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each centroid and size, the cosine that one in a hundred of a language's texts stays below.

    Texts (``rows`` are their vectors) and beginnings of them are measured by centroids fitted on the other half of the
    texts; very few texts are measured by ``centroids`` themselves. A size with fewer than ``OWN_TEXTS`` texts of a
    centroid takes those of the language; one with none takes the next smaller size.
    """
    few = len(texts) < 20
    halves = [centroids, centroids] if few else [spherical_kmeans(rows[1::2], CENTROIDS), spherical_kmeans(rows[::2], CENTROIDS)]
    other = np.arange(len(texts)) % 2
    sizes, owners, cosines = [], [], []
    for end in [*(1 << np.arange(2, 15)), None]:  # None: the whole text
        part = [(k, c) for k, t in enumerate(texts) if end is None or len(t) > end if (c := ngram_counts(t[:end])) is not None]
        if part:
            at, cut = np.array([k for k, _ in part]), vectors([c for _, c in part], idf)
            by_half = np.stack([(cut @ half.T).max(axis=1) for half in halves])
            sizes.append(np.log2([np.count_nonzero(c) for _, c in part]).round().clip(_SIZES[0], _SIZES[-1]))
            owners.append((cut @ centroids.T).argmax(axis=1))
            cosines.append(by_half[other[at], np.arange(len(at))])
    out = np.zeros((len(centroids), len(_SIZES)))
    if sizes:
        size, owner, cosine = map(np.concatenate, (sizes, owners, cosines))
        for n, k in np.ndindex(out.shape[::-1]):
            of_all = size == _SIZES[n]
            own = of_all & (owner == k)
            chosen = cosine[own if own.sum() >= OWN_TEXTS else of_all]
            out[k, n] = np.quantile(chosen, 0.01) if len(chosen) else out[k, n - 1] if n else 0
    return out


def least_accepted(model: Model, best: np.ndarray, counts: list[np.ndarray | None]) -> np.ndarray:
    """The smallest accepted cosine of each text, by its nearest centroid and between the two sizes next to its own."""
    n = np.array([max(1, np.count_nonzero(c)) if c is not None else 1 for c in counts])
    place = np.log2(n).clip(_SIZES[0], _SIZES[-1]) - _SIZES[0]
    low = np.minimum(place.astype(int), len(_SIZES) - 2)
    return model.least[best, low] * (1 + low - place) + model.least[best, low + 1] * (place - low)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und``, with score 0, and rejected; so is every text if the model has no
    centroid. Of equally near centroids the first by language counts. All columns stay, but those of these three names
    are replaced. Only ``text`` is read for the prediction.
    """
    if not model.languages:
        nothing = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)}
        return docs.withColumns(nothing)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        model, judged = shared.value, []
        for at in range(0, len(texts), _BATCH):
            counts = [ngram_counts(x) for x in texts.iloc[at : at + _BATCH]]
            cosines = vectors(counts, model.idf) @ model.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
            known = np.array([c is not None for c in counts])
            judged.append(
                pd.DataFrame(
                    {
                        "lang_pred": np.where(known, np.array(model.languages, object)[best], UNKNOWN),
                        "score": np.where(known, score, 0.0),
                        "rejected": ~known | (score < least_accepted(model, best, counts)),
                    }
                )
            )
        return pd.concat(judged) if judged else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    # A filter on the result would otherwise judge every text a second time.
    with_judgement = docs.withColumn("__judged", judge.asNondeterministic()(F.col(text)))
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return with_judgement.select(*others, "__judged.lang_pred", "__judged.score", "__judged.rejected")


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text leaves 2 modulo 4; without id it is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
