"""Language identification by a string kernel.

Blended-spectrum presence kernel: k(x, y) is the number of distinct n-grams (1 to `longest` letters of the lower-cased
text) that x and y both have, over the root of the product of their numbers. Landmarks give a Nyström approximation,
on which one-versus-rest kernel ridge regression is solved. As the kernel is linear in presence, a text's score is its
presence vector times (landmarks' presence, transposed, times the dual weights); that product is made once, and texts
are scored by a matrix product a batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Fit:
    """rows: texts of each language that are learnt from at most, those of least hash; all_rows: of all languages together.
    landmarks, all_landmarks: the same for landmarks. languages: learnt at most, those of most rows. bits: n-grams are hashed
    to 2**bits features. longest: letters of the longest n-gram. ridge: of the regression."""

    rows: int = 400
    all_rows: int = 8192
    landmarks: int = 64
    all_landmarks: int = 768
    languages: int = 512
    bits: int = 15
    longest: int = 3
    ridge: float = 1e-4


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    fit: Fit


def spectrum(text: str, bits: int, longest: int, slab: int = 1 << 20) -> np.ndarray:
    """Presence of the text's hashed n-grams, whole texts in slabs that overlap."""
    out = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    for at in range(0, len(text), slab):
        code = np.frombuffer(text[at : at + slab + longest - 1].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = np.zeros(len(code) + 1, np.uint64)
        for n in range(1, longest + 1):
            if len(code) < n:
                break
            h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * MIX
            h ^= h >> np.uint64(29)
            out[(h * MIX) >> shift] = True
    return out


def presence(text: Column, fit: Fit) -> Column:
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([np.packbits(spectrum(t.as_py() or "", fit.bits, fit.longest)).tobytes() for t in texts], pa.binary())

    return packed(text.cast("string"))


def learn(labelled: DataFrame, fit: Fit = Fit(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from a bounded sample of rows of each language (see Fit). Rows with a null text or language are ignored.

    What comes to the driver are about twice all_rows presence vectors of 2**bits bits, whatever the number of languages
    and the texts' lengths.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit.languages).collect()}
    if not sizes:
        return Model((), np.zeros((1 << fit.bits, 0), np.float32), fit)
    each, marks = max(1, min(fit.rows, fit.all_rows // len(sizes))), max(1, min(fit.landmarks, fit.all_landmarks // len(sizes)))
    # Hashes are even, so those below this edge are twice as many as are wanted; all of a small language.
    edges = [(g, -(2**63) + min(2**64 - 1, 2**64 * 2 * each // n)) for g, n in sizes.items()]
    edges = F.broadcast(spark.createDataFrame(edges, "lang string, edge long"))
    rows = known.join(edges, "lang").where("h <= edge").select("lang", "h", presence(F.col("text"), fit).alias("x")).collect()
    own: dict[str, list] = {g: [] for g in sorted(sizes)}
    for r in sorted(rows, key=lambda r: (r.h, r.x)):
        if len(own[r.lang]) < each:
            own[r.lang].append(r.x)
    languages = tuple(own)
    packed = [x for g in languages for x in own[g]]

    def unit(part: list[bytes]) -> np.ndarray:
        X = np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(len(part), -1).astype(np.float32)
        return X / np.sqrt(np.maximum(X.sum(1, keepdims=True), 1))

    L = unit([x for g in languages for x in own[g][:marks]])
    knm = np.concatenate([unit(packed[k : k + 256]) @ L.T for k in range(0, len(packed), 256)]).astype(float)
    of = np.repeat(np.arange(len(languages)), [len(own[g]) for g in languages])
    Y = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    kmm = (L @ L.T).astype(float)
    dual = np.linalg.lstsq(knm.T @ knm + fit.ridge * len(packed) * kmm + 1e-9 * np.eye(len(L)), knm.T @ Y, rcond=None)[0]
    return Model(languages, (L.T @ dual.astype(np.float32)), fit)


def language(text: Column, model: Model) -> Column:
    """struct<lang_pred, score>: `und` and 0 for null texts, texts without a letter, or without a model."""
    names, W, fit = model.languages, model.weights, model.fit

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), 64) if names else ():
            part = [t.as_py() for t in texts[at : at + 64]]
            use = [i for i, t in enumerate(part) if t and LETTER.search(t)]
            if not use:
                continue
            X = np.stack([spectrum(part[i], fit.bits, fit.longest) for i in use]).astype(np.float32)
            f = (X @ W) / np.sqrt(np.maximum(X.sum(1, keepdims=True), 1))
            top = f.argmax(1)
            for i, k, v in zip(use, top, f.max(1), strict=True):
                lang[at + i], score[at + i] = names[k], min(1.0, max(0.0, (1 + float(v)) / 2))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict(text.cast("string"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`, which replace columns of these names."""
    return docs.withColumn("_predicted", language(F.col(text), model)).withColumns({"lang_pred": F.col("_predicted.lang_pred"), "score": F.col("_predicted.score")}).drop("_predicted")
