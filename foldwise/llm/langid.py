"""Language identification: softmax regression on TF-IDF character n-grams, with temperature calibration.

Features are hashed 1- to 3-grams of the lower-cased code points, weighted ``(1 + ln tf) * idf`` and L2-normalised.
Document frequencies cover every training row. The model is fitted by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample (``Params.sample_rows``, shared equally by the languages); a quarter of the
sample is held back to fit the temperature. Every row is predicted, whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text when nothing could be
learned; rows with a null language are never learned from; a null id is predicted like any other; repeated rows give
a row each; only the id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_fraction, id_text
from .ftrl import Ftrl, softmax, temperature

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Params:
    bits: int = 16
    orders: int = 3
    sample_rows: int = 2400   # bound on the rows that the model is fitted on
    passes: int = 2
    alpha: float = 0.5
    l1: float = 0.02
    l2: float = 0.02


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray       # languages x (features + bias)
    idf: np.ndarray
    temperature: float


def grams(text: str, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and their counts."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    dims, shift = 1 << params.bits, np.uint32(32 - params.bits)
    h, parts = np.full(len(cp), 1, np.uint32), []
    for n in range(params.orders):
        h = (h[:len(cp) - n] ^ cp[n:]) * np.uint32(0x9E3779B1) + np.uint32(n) if n < len(cp) else h[:0]
        h ^= h >> np.uint32(15)
        parts.append((h * np.uint32(0x85EBCA6B)) >> shift)
    idx = np.concatenate(parts)
    if len(idx) < 6000:
        at, tf = np.unique(idx, return_counts=True)
        return at.astype(np.int64), tf
    tf = np.bincount(idx, minlength=dims)
    at = np.flatnonzero(tf)
    return at, tf[at]


def _weigh(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(tf)) * idf[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _has_letter(t: str) -> bool:
    return _LETTER.search(t) is not None


def document_frequencies(docs: DataFrame, params: Params) -> tuple[np.ndarray, int]:
    """Document counts by feature over all rows of ``(doc_id, text)``, and the number of rows: one small vector a task."""
    def work(it: Iterator[pa.RecordBatch]):
        df, n = np.zeros(1 << params.bits, np.int64), 0
        for _, texts in batches(it):
            for t in texts:
                df[grams(t.decode("utf-8", "replace"), params)[0]] += 1
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["at", "n"])

    rows = docs.mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << params.bits), 0
    for r in rows:
        if r["at"] < 0:
            n = r["n"]
        else:
            df[r["at"]] = r["n"]
    return df, n


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learns from all rows of ``docs`` with text and language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), np.zeros((0, 1)), np.zeros(1), 1.0)
    df, n = document_frequencies(id_text(known, id_col, text_col), params)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    per = params.sample_rows / len(languages)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, 0.9 * per / counts[k])])
    drawn = id_text(known.where(hash_fraction(F.col(id_col), 7) < F.element_at(share, F.col(lang_col))), id_col, text_col,
                    F.col(lang_col).alias("lang")).limit(params.sample_rows)

    def work(it):
        for b, texts in batches(it):
            got = [grams(t.decode("utf-8", "replace"), params) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                 pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], ["doc_id", "lang", "at", "tf"])

    got = drawn.mapInArrow(work, "doc_id long, lang string, at array<int>, tf array<int>").toArrow()
    rows, labels, back, back_labels = [], [], [], []
    ids = got.column("doc_id").fill_null(-1).to_numpy()
    lang, at, tf = (got.column(c).combine_chunks() if got.num_rows else [] for c in ("lang", "at", "tf"))
    for k, i in enumerate(np.argsort(ids, kind="stable").tolist()):
        a = np.asarray(at[i].values).astype(np.int64)
        row = (a, _weigh(a, np.asarray(tf[i].values), idf))
        to, to_labels = (back, back_labels) if k % 4 == 3 else (rows, labels)
        to.append(row)
        to_labels.append(languages.index(lang[i].as_py()))
    ftrl = Ftrl(1 << params.bits, max(2, len(languages)), alpha=params.alpha, l1=params.l1, l2=params.l2)
    w = ftrl.fit(rows, labels, params.passes).weights()[:len(languages)]
    logits = np.array([w[:, a] @ v + w[:, -1] for a, v in back]).reshape(len(back), len(languages)).T
    return Model(languages, w, idf, temperature(logits, np.array(back_labels, dtype=int)))


def _predictor(model: Model, params: Params):
    """Text -> language and calibrated probability."""
    w, idf = model.weights.astype(np.float32), model.idf.astype(np.float32)
    languages, heat = model.languages, model.temperature

    def one(t: str) -> tuple[str, float]:
        if not languages or not _has_letter(t):
            return UNDETERMINED, 0.0
        at, tf = grams(t, params)
        p = softmax((w[:, at] @ _weigh(at, tf, idf) + w[:, -1]).astype(np.float64) / heat)
        k = int(p.argmax())
        return languages[k], float(p[k])

    return one


def predict(docs: DataFrame, model: Model, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; the score is the calibrated probability of the language."""
    def work(it):
        one = _predictor(model, params)
        for b, texts in batches(it):
            got = [one(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float, params: Params = Params(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is identified with at least ``least_score``."""
    def work(it):
        one = _predictor(model, params)
        for b in it:
            got = [one(t or "") for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array([k != UNDETERMINED and p >= least_score for k, p in got], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
