"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their first four letters, hashed. The score is a logistic
function of w0 + sum w_i + sum <v_i, v_j>: the weights w see an insult alone, the products of the factors v see two
terms that only matter together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import drop, written

#: Hashed terms, factors of each; the model has BUCKETS * (FACTORS + 1) numbers, whatever the corpus.
BUCKETS, FACTORS = 1 << 18, 6
#: The classifier is fitted on at most this many labelled rows (those first by a hash of their id).
TRAIN_ROWS = 24_000
#: Terms with fewer training documents, or less tied to the label than this z-score, stay 0.
LEAST_DOCS, LEAST_Z = 3, 2.0
#: Terms that may differ from 0.
MOST_TERMS = 1 << 16
EPOCHS, RATE, SHRINK = 6, 0.3, 1e-5
LETTERS = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Hashed terms of a word, kept for words seen."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        full = xxhash.xxh3_64_intdigest(word.encode(errors="replace")) % BUCKETS
        got = (full, xxhash.xxh3_64_intdigest(b"^" + word[:4].encode(errors="replace")) % BUCKETS) if len(word) > 4 else (full,)
        if len(word) <= 40:
            if len(self) >= 60_000:
                self.clear()
            self[word] = got
        return got


_terms = Terms()


def hashed_terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a whole text, sorted."""
    seen = set()
    for word in set(LETTERS.findall(text.lower())):
        seen.update(_terms[word])
    return np.array(sorted(seen), dtype=np.int32)


class FactorizationMachine:
    """Weights and factors; all 0 (so every score is the base rate) where nothing was learned."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margins(self, terms: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For documents whose terms are terms[begins[i]:begins[i + 1]]."""
        if not len(terms):
            return np.full(len(begins) - 1, self.w0)
        v = self.v[terms]
        # one row of zeros at the end, so that an empty document may start there
        sums = lambda x: np.where((np.diff(begins) > 0).reshape(-1, *[1] * (x.ndim - 1)), np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]), x.dtype)]), begins[:-1], axis=0), 0)
        s = sums(v)
        return self.w0 + sums(self.w[terms]) + 0.5 * ((s * s).sum(axis=1) - sums((v * v).sum(axis=1)))

    def scores(self, terms: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(terms, begins).astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
        """Logistic loss by AdaGrad over small batches. With one label only, scores are 0 or 1 throughout; without rows, 0."""
        labels = np.asarray(labels, dtype=np.float64)
        n, pos = len(labels), labels.sum() if len(labels) else 0
        w, v = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32)
        if n == 0 or pos in (0, n):
            return cls(30.0 if n and pos == n else -30.0, w, v)
        both = np.concatenate(docs)
        y = np.repeat(labels, [len(d) for d in docs])
        df, df1 = np.bincount(both, minlength=BUCKETS), np.bincount(both, weights=y, minlength=BUCKETS)
        rate = pos / n
        z = (df1 - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9))
        used = (df >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
        docs = [d[used[d]] for d in docs]
        rng = np.random.default_rng(seed)
        # terms that speak for the label begin at half their log odds: where all rows are told apart already, gradients would leave rarer evidence too low
        odds = np.log((df1 + 0.5) / (pos + 1)) - np.log((df - df1 + 0.5) / (n - pos + 1))
        w[:] = np.where(used & (z > 2 * LEAST_Z), 0.5 * np.maximum(odds, 0), 0)
        v[used] = rng.normal(0, 0.01, (int(used.sum()), FACTORS))
        m = cls(float(np.log(rate / (1 - rate))), w, v)
        gw, gv, g0 = np.full(BUCKETS, 1e-6), np.full((BUCKETS, FACTORS), 1e-2), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 128):
                rows = order[at : at + 128]
                own = [docs[i] for i in rows]
                lens = np.array([len(d) for d in own])
                begins = np.concatenate([[0], np.cumsum(lens)])
                terms = np.concatenate(own).astype(np.int64)
                err = m.scores(terms, begins) - labels[rows]
                g0 += (g := err.mean()) ** 2
                m.w0 -= RATE * g / np.sqrt(g0)
                if not len(terms):
                    continue
                where, inv = np.unique(terms, return_inverse=True)
                doc = np.repeat(np.arange(len(rows)), lens)
                e = err[doc] / len(rows)
                s = np.zeros((len(rows), FACTORS))
                np.add.at(s, doc, v[terms])
                dw = np.bincount(inv, weights=e, minlength=len(where)) + SHRINK * w[where]
                part = e[:, None] * (s[doc] - v[terms])
                dv = np.stack([np.bincount(inv, weights=part[:, f], minlength=len(where)) for f in range(FACTORS)], axis=1) + SHRINK * v[where]
                gw[where] += dw**2
                gv[where] += dv**2
                w[where] -= RATE * dw / np.sqrt(gw[where])
                v[where] -= 0.2 * RATE * dv / np.sqrt(gv[where])
        return m


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning; null for a null id, whose label teaches nothing either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Learn from at most ``rows`` labelled ids that are not held out; rows with a null id or label, or a label but 0 and 1, are passed over.

    Of documents that repeat an id, one teaches for each of its labels. The labelled documents' terms are written to the shared folder and
    counted there; the driver gets the ``MOST_TERMS`` terms most tied to the label, and of each document those only.
    """
    spark = docs.sparkSession
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    y = y.where(~held_out(F.col("id"))).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), "id").select("id", "text", "y")  # at most `rows` ids

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashed_terms(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "terms"])

    found = x.mapInArrow(terms, f"id {x.dtypes[0][1]}, y int, terms array<int>")
    taught = written(found.groupBy("id", "y").agg(F.max("terms").alias("terms")).drop("id"))
    n, pos = taught.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if pos in (0, n):
        return FactorizationMachine.fit([np.zeros(0, np.int32)] * min(n, 1), np.array([1] * min(pos, 1) or [0] * min(n, 1)))
    rate = pos / n
    z = F.abs(F.col("d1") - F.col("d") * rate) / F.sqrt(F.col("d") * rate * (1 - rate))
    per = taught.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("d1")).where(F.col("d") >= LEAST_DOCS)
    tied = per.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_TERMS).select("term").toArrow()
    used = np.zeros(BUCKETS, dtype=bool)
    used[tied.column(0).to_numpy()] = True
    mask = spark.sparkContext.broadcast(used)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(t.values, dtype=np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([t[mask.value[t]].tobytes() for t in own], pa.binary()), b.column(0)], ["terms", "y"])

    got = sorted(zip(*(c.to_pylist() for c in taught.select("y", "terms").mapInArrow(tell, "terms binary, y int").toArrow().columns)))
    mask.destroy()
    drop(taught)
    return FactorizationMachine.fit([np.frombuffer(t, dtype=np.int32) for t, _ in got], np.array([y for _, y in got]))


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a double column ``name`` (a column of that name is replaced): the model's score of the whole text.

    A null text is scored as an empty one. Only the text is read for it.
    """
    used = np.flatnonzero((model.w != 0) | (model.v != 0).any(axis=1))  # at most MOST_TERMS after :func:`fit`
    shared = df.sparkSession.sparkContext.broadcast((model.w0, used, model.w[used], model.v[used]))
    keep = [c for c in df.columns if c.lower() != name.lower()]
    place = keep.index(next(c for c in keep if c.lower() == text_col.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, used, w, v = shared.value
        m, at = FactorizationMachine(w0, w, v), np.full(BUCKETS, -1, dtype=np.int64)
        at[used] = np.arange(len(used))
        for b in batches:
            docs = [d[d >= 0] for d in (at[hashed_terms(t.as_py() or "")] for t in b.column(place))]
            begins = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(np.concatenate([*docs, np.zeros(0, np.int64)]), begins))], [*keep, name])

    x = df.select(*keep)
    return x.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in x.dtypes) + f", `{name}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under ``threshold``, columns as in ``docs``."""
    name = "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return score(docs, fit(docs, labels), name=name).where(F.col(name) < threshold).drop(name)
