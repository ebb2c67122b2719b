"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (one to three letters, with
everything that is no letter as one separator), damped, weighted by inverse
document frequency and scaled to length one. Each language has several
centroids, found by spherical k-means over a bounded sample of its labelled
texts. The language of the centroid with the largest cosine is predicted. A text
is rejected when that cosine is less than a share of a low quantile, measured on
the sample's texts of that language, and pieces of them, of about that length.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches, beside

DIM = 4096
PIECE = 1 << 20
BUCKETS = 32
UNKNOWN = "und"
SHORTEST, LONGEST = 1, 11  # pieces of 2, 4, .. 2048 characters
QUANTILE, MARGIN = 0.01, 0.75
ENOUGH, FULL = 20, 200  # texts of a language, and texts and pieces of about one length, whose quantile tells something


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # language x bucket of length: least cosine that is not rejected


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


def profile(text: str | None) -> np.ndarray | None:
    """n-gram counts by hash; None if there is no letter. Long texts go piece by piece, each n-gram in the piece it ends in."""
    if not text:
        return None
    letters, low, total = _letters(), text.lower(), None
    for start in range(0, len(low), PIECE):
        seen = min(2, start)  # code points that were counted in the piece before
        points = np.frombuffer(low[start - seen : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = letters[points]
        if not alpha.any():
            continue
        one = np.where(alpha, points, 32).astype(np.uint32)
        grams = [one[seen:][alpha[seen:]] * np.uint32(2654435761)]
        if len(one) > 1:
            two = one[:-1] * np.uint32(2246822519) + one[1:] * np.uint32(3266489917)
            grams.append(two[max(0, seen - 1) :][(alpha[:-1] | alpha[1:])[max(0, seen - 1) :]])
        if len(one) > 2:
            three = two[:-1] * np.uint32(668265263) + one[2:] * np.uint32(374761393)
            grams.append(three[alpha[1:-1]])
        # One more mixing step, so that the high bits depend on every letter.
        mixed = np.concatenate(grams)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
        counts = np.bincount(mixed >> np.uint32(20), minlength=DIM)
        total = counts if total is None else total + counts
    return total if total is not None and total.any() else None


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(out, axis=-1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(int), BUCKETS - 1)


def _pack(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def _unpack(blobs: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(blobs), DIM), np.float32)
    for i, blob in enumerate(blobs):
        n = len(blob) // 6
        counts[i, np.frombuffer(blob, "<u2", n)] = np.frombuffer(blob, "<f4", n, 2 * n)
    return counts


def pieces(text: str) -> Iterator[str]:
    """A piece of each length below the text's, from a place that its checksum picks."""
    place = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for k in range(SHORTEST, LONGEST + 1):
        if (rest := len(text) - (1 << k)) > 0:
            start = place * (2 * k + 1) % (rest + 1)
            yield text[start : start + (1 << k)]


def floors(cosines: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least cosine that is not rejected, by bucket; buckets of too few texts take that of the next shorter or, if there is none, longer one."""
    counts = np.bincount(size, minlength=BUCKETS)
    full = np.flatnonzero(counts >= min(FULL, max(ENOUGH, counts.max() // 2), counts.max()))
    own = np.array([MARGIN * np.quantile(cosines[size == b], QUANTILE) for b in full])
    return np.maximum(0.0, own[np.maximum(np.searchsorted(full, np.arange(BUCKETS), "right") - 1, 0)])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from vectors far from one another."""
    centres = [vectors.mean(0)]
    while len(centres) < min(k, len(vectors)):
        nearest = (vectors @ np.stack(centres).T).max(1)
        centres.append(vectors[int(np.argmin(nearest))])
    centres = np.stack(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        owner = (vectors @ centres.T).argmax(1)
        centres = np.stack([vectors[owner == i].mean(0) if (owner == i).sum() > 1 else centres[i] for i in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str | Column = "doc_id", per_language: int = 400, clusters: int = 4) -> Model:
    """Learn from the rows of ``df``, which the caller has limited to training rows.

    About ``per_language`` rows of each language are used, of all its languages,
    picked by a hash of ``key`` and text; rows that agree in both count once.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return learn([], clusters)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / max(1, n)))])
    picked = rows.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, blobs, parts = [], [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (counts := profile(t)) is not None:
                    langs.append(name)
                    blobs.append(_pack(counts))
                    parts.append([_pack(c) for x in pieces(t) if (c := profile(x)) is not None])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(blobs, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], names=["lang", "grams", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns])]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows, clusters))])], names=["model"])

    # The sample is bounded, so one task holds it; the driver sees the model alone.
    found = picked.mapInArrow(profiles, "lang string, grams binary, pieces array<binary>").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn([], clusters)


def learn(rows: list[tuple[str, bytes, list[bytes]]], clusters: int) -> Model:
    """The model of (language, packed counts of a text, those of its pieces)."""
    rows = sorted(rows)
    names, blobs, parts = ([r[k] for r in rows] for k in range(3))
    counts = _unpack(blobs)
    names = np.array(names, dtype=object)
    known = sorted(set(names))
    if not known:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros((0, BUCKETS)))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    buckets = bucket_of(counts.sum(1))
    vectors = weigh(counts, idf)
    owner, centroids = [], []
    floor = np.zeros((len(known), BUCKETS))
    for i, name in enumerate(known):
        own = vectors[names == name]
        found = _clusters(own, clusters)
        centroids.append(found)
        owner += [i] * len(found)
        best, size = [(own @ found.T).max(1)], [buckets[names == name]]
        short = [x for k in np.flatnonzero(names == name) for x in parts[k]]
        for k in range(0, len(short), 256):
            some = _unpack(short[k : k + 256])
            best.append((weigh(some, idf) @ found.T).max(1))
            size.append(bucket_of(some.sum(1)))
        floor[i] = floors(np.concatenate(best), np.concatenate(size))
    # A few texts lie too near to their own centroids to tell how far others lie.
    many = np.array([(names == name).sum() >= ENOUGH for name in known])
    if many.any():
        floor[~many] = floor[many].min(0)
    return Model(known, np.array(owner), np.concatenate(centroids), idf, floor)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for start in range(0, len(texts), 256):
        found = [(i, c) for i, t in enumerate(texts[start : start + 256], start) if (c := profile(t)) is not None]
        if not found or not model.languages:
            continue
        counts = np.stack([c for _, c in found])
        cosines = weigh(counts, model.idf) @ model.centroids.T
        best = cosines.argmax(1)
        for (i, _), c, row, b in zip(found, best, cosines, bucket_of(counts.sum(1))):
            lang = model.owner[c]
            langs[i], scores[i] = model.languages[lang], min(1.0, max(0.0, float(row[c])))
            rejected[i] = row[c] < model.floor[lang, b]
    return langs, scores, rejected


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred, score and rejected for every row.

    A text that is null or has no letter gets ``und``, score 0, and is rejected;
    so does every text if the model has learned no language. Equal texts get
    equal results, repeated rows stay, an empty table gives an empty result, and
    other columns of the table are not read. Ties go to the first language by name.
    """
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.col(text).alias(beside(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict(batch.column(len(keep)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["lang_pred string", "score double", "rejected boolean"])
    return source.mapInArrow(run, schema)
