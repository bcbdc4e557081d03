"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Learning uses text and lang of documents whose crc32(doc_id as text) mod 3 is not 1 (and is known). Document frequencies are
counted over all of them, in one pass without moving text. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on at most ``PER_LANGUAGE`` documents a language and ``AT_MOST`` in all, those of least hash; a fifth of these
is not fitted on: it chooses the penalty, the largest that costs no accuracy there, and then the temperature that calibrates the scores.
At most ``AT_MOST`` languages are learned, the first by code point.

Rows: one per input row. A letter is what Unicode calls one (a number such as a superscript is none). A text that is null or has no letter is ``und`` with score 0, as is every text where nothing
could be learned from (no labelled rows). A null doc_id is never learned from and counts as not held out. Long texts are read
whole, in pieces. Repeated rows are predicted alike; other columns are not read.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from codecairn.llm.tables import fields, map_rows, table, typed

#: n-grams of 1 to 3 characters are hashed to this many features, which bounds the model.
FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: The bounds of the sample that the weights are fitted on.
PER_LANGUAGE, AT_MOST = 800, 8000
PASSES = 3
ALPHA, BETA = 1.0, 1.0
#: Penalties to choose from, for the absolute and the squared weights alike, and the share of accuracy that a larger one may cost.
PENALTIES, MAY_COST = (0.1, 0.03, 0.01, 0.001), 0.001
PIECE = 1 << 18
_LETTER, _OTHERS = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the lower-cased text, in which all but letters reads as a space."""
    out = np.zeros(FEATURES, np.int64)
    text = " " + _OTHERS.sub(" ", text.lower()) + " "
    reach = max(ORDERS) - 1
    for first in range(0, len(text), PIECE):
        codes = np.frombuffer(text[first:first + PIECE + reach].encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = min(PIECE, len(text) - first)
        h = np.zeros(len(codes), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            h = (h[:len(codes) - order + 1] + codes[order - 1:]) * _MULTIPLIER
            if order in ORDERS:
                out += np.bincount((h[:n] >> np.uint64(49)).astype(np.int64), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def learnable(docs: DataFrame) -> Column:
    return (fold(docs) != 1) & F.col("lang").isNotNull()


def fold(docs: DataFrame) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by feature, and documents. A task sends one row per feature at most; the sum has ``FEATURES`` rows."""
    def task(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if has_letter(t):
                    df += counts(t) > 0
                    n += 1
        at = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *df[at].tolist()], pa.int64())],
                                             ["feature", "n"])

    got = map_rows(rows, ["text"], T.StructType(typed("feature bigint, n bigint")), task).groupBy("feature").agg(
        F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES, np.int64)
    known = got[got["feature"] >= 0]
    df[known["feature"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    return df, int(got.loc[got["feature"] < 0, "n"].sum())


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features of the text and their TF-IDF values, of length 1."""
        c = counts(text)
        at = np.flatnonzero(c)
        x = c[at] * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*self.vector(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: int, penalty: float = PENALTIES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``PASSES`` over the rows (features, values, class). Feature ``FEATURES`` is the bias, unpenalised."""
    z, n = np.zeros((FEATURES + 1, langs)), np.zeros((FEATURES + 1, langs))
    l1, l2 = np.full(FEATURES + 1, penalty), np.full(FEATURES + 1, penalty)
    l1[-1] = l2[-1] = 0

    def weights(at):
        a, b = z[at], n[at]
        shrunk = np.sign(a) * np.maximum(np.abs(a) - l1[at, None], 0)
        return -shrunk / ((BETA + np.sqrt(b)) / ALPHA + l2[at, None])

    for _ in range(PASSES):
        for at, x, y in rows:
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    w = weights(np.arange(FEATURES + 1))
    return w[:-1].astype(np.float32), w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fitted(model: Model, rows: list, held: list) -> Model:
    """The model with the weights of the largest penalty whose accuracy on the held rows is within ``MAY_COST`` of the best one's.

    Without held rows the smallest penalty is taken. Rows: (features, values, class).
    """
    tried = []
    for penalty in PENALTIES if held else PENALTIES[-1:]:
        model.weights, model.bias = ftrl(rows, len(model.langs), penalty)
        right = sum(int(model.logits(a, x).argmax()) == y for a, x, y in held)
        tried.append((right, model.weights, model.bias))
    best = max(t[0] for t in tried)
    _, model.weights, model.bias = next(t for t in tried if t[0] >= best - MAY_COST * len(held))
    if held:
        model.temperature = calibrate(np.array([model.logits(a, x) for a, x, _ in held]), np.array([y for *_, y in held]))
    return model


def train(docs: DataFrame) -> Model:
    rows = docs.filter(learnable(docs)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(AT_MOST).collect()}
    df, n = document_frequencies(rows)
    if not sizes or not n:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), np.zeros(FEATURES))
    langs = sorted(sizes)
    model = Model(langs, np.zeros((FEATURES, len(langs)), np.float32), np.zeros(len(langs)),
                  np.log((1 + n) / (1 + df)) + 1)
    each = max(1, min(PER_LANGUAGE, AT_MOST // len(langs)))
    # Twice the wanted share is drawn by hash, and of that the least ones: a bound that holds, and every task cuts its own rows first.
    share = F.create_map(*(F.lit(v) for lang in langs for v in (lang, min(1.0, 2 * each / sizes[lang]))))[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    least = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text", F.lit(1))))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share).withColumn("k", least).filter(F.col("k") <= each)
    idf, class_of = model.idf, {lang: i for i, lang in enumerate(langs)}

    def task(batches):
        for b in batches:
            kept = [(zlib.crc32(str(i).encode()) // 3 % 5 == 0, class_of[lang], *Model([], None, None, idf).vector(t))
                    for i, t, lang in zip(*(b.column(k).to_pylist() for k in range(3))) if has_letter(t)]
            columns = [pa.array([k[0] for k in kept], pa.bool_()), pa.array([k[1] for k in kept], pa.int64()),
                       pa.array([k[2].astype(np.int32).tobytes() for k in kept], pa.binary()),
                       pa.array([k[3].astype(np.float32).tobytes() for k in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["calibrates", "y", "at", "x"])

    sample = map_rows(drawn, ["doc_id", "text", "lang"],
                      T.StructType(typed("calibrates boolean, y bigint, at binary, x binary")), task)
    got = sorted((zlib.crc32(r["at"] + r["x"]), bytes(r["at"]), bytes(r["x"]), r["y"], r["calibrates"]) for r in sample.collect())
    vectors = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(np.float64), y, c) for _, a, x, y, c in got]
    return fitted(model, [v[:3] for v in vectors if not v[3]] or [v[:3] for v in vectors], [v[:3] for v in vectors if v[3]])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The model is of fixed size a language and travels with the function."""
    schema = T.StructType([*fields(docs, "doc_id"), *typed("held_out boolean, lang_pred string, score double")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], schema.names)

    held = docs.select("doc_id", F.coalesce(fold(docs) == 1, F.lit(False)).alias("held_out"), "text")
    return map_rows(held, held.columns, schema, task)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
