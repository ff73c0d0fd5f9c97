"""Toxicity by a factorization machine over hashed terms.

Terms: each word, and its first 4, 5, 6 and 7 bytes (so that inflected or compounded insults meet),
hashed to 2**18 slots.  A term's value is its share of the words of the document times ``SCALE``, at most 1, so
that long and short texts are alike.  The score is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum v_if^2 x_i^2 ]

whose last part learns pairs: an insult counts for more beside a mention of a group than alone.

Training uses at most ``sample_rows`` labelled rows, those of the smallest hash of their id: their ids (the bound
makes their number fixed) are broadcast, the term vectors are built where the texts are, and one task fits the
machine by AdaGrad.  The model has a fixed size (2**18 * 5 numbers), is written to the shared folder and broadcast.
Every document is then scored, over its whole text.

Defined cases: ids of any type; a NULL or empty text has no terms and is not toxic (its score is that of the bias); a NULL
label row is ignored; ids labelled twice are used once, toxic if any label says so; repeated rows get equal scores;
without labels of both classes nothing is toxic (score 0); an empty table gives an empty table; columns
named ``toxicity`` or ``toxic`` stay and the new ones get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.llm.vectortext import chunks, distinct_pairs, fold, runs, segment_sum, span_hashes, words
from termgraph.storage import fresh_name, materialise

SLOT_BITS = 18
FACTORS = 4
SCALE = 50.0
PREFIXES = (4, 5, 6, 7)
SAMPLE_ROWS = 15_000
THRESHOLD = 0.4
EPOCHS = 8
_CUT = 1 << 20


def term_vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, slot, value) of the distinct terms of each text, in order."""
    h, owner, starts = words(raw, offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    low = fold(raw)
    follow = np.append(starts[1:], len(raw))
    all_h, all_o = [h], [owner]
    word = np.zeros(len(raw) + 8, dtype=bool)
    word[: len(raw)] = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    long_ = np.ones(len(starts), bool)
    step = 0
    for n in PREFIXES:
        for k in range(step, n + 1):  # a prefix is a term of its own only where the word goes on
            long_ &= word[starts + k] & (starts + k < follow)
        step = n + 1
        s = starts[long_ & (starts + n < offsets[owner + 1])]
        all_h.append(span_hashes(low, s, s + n) ^ np.uint64(n))
        all_o.append(owner[long_ & (starts + n < offsets[owner + 1])])
    size = np.bincount(owner, minlength=len(offsets) - 1)
    doc, slot, count = distinct_pairs(np.concatenate(all_o), np.concatenate(all_h) >> np.uint64(64 - SLOT_BITS), SLOT_BITS)
    return doc, slot, np.minimum(count * (SCALE / size[doc]), 1).astype(np.float32)


class Machine:
    """Weights of the factorization machine; ``score`` takes vectors as term_vectors gives them."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    def score(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        known = (self.weight[slot] != 0) | (self.factor[slot, 0] != 0)  # terms that training never saw weigh nothing
        doc, slot, value = doc[known], slot[known], value[known]
        linear = np.bincount(doc, weights=self.weight[slot] * value, minlength=n)
        vx = self.factor[slot] * value[:, None]
        pairs = (segment_sum(vx, doc, n) ** 2 - segment_sum(vx * vx, doc, n)).sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -30, 30)))

    def dump(self) -> bytes:
        return np.concatenate([[self.bias], self.weight, self.factor.ravel()]).astype(np.float32).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        a = np.frombuffer(data, np.float32)
        n = 1 << SLOT_BITS
        return cls(float(a[0]), a[1 : 1 + n], a[1 + n :].reshape(n, FACTORS))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.1, decay: float = 1e-5, least_docs: int = 3) -> Machine:
    """AdaGrad on the logistic loss; ``docs`` are (slots, values).  Terms in fewer than ``least_docs`` of them are left out."""
    n = 1 << SLOT_BITS
    seen = np.bincount(np.concatenate([d[0] for d in docs]) if docs else np.zeros(0, np.int64), minlength=n)
    rng = np.random.default_rng(5)
    w, v = np.zeros(n, np.float32), np.where((seen >= least_docs)[:, None], rng.normal(0, 0.02, (n, FACTORS)), 0).astype(np.float32)
    gw, gv, bias, gb = np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32), 0.0, 1e-2
    docs = [(s[k], x[k]) for s, x in docs for k in [seen[s] >= least_docs]]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            doc = np.repeat(np.arange(len(own)), [len(docs[i][0]) for i in own])
            slot, value = np.concatenate([docs[i][0] for i in own]), np.concatenate([docs[i][1] for i in own])
            vx = v[slot] * value[:, None]
            total = segment_sum(vx, doc, len(own))
            raw = bias + np.bincount(doc, weights=w[slot] * value, minlength=len(own)) + (total**2 - segment_sum(vx * vx, doc, len(own))).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]).astype(np.float32) / len(own) * 16
            e = error[doc]
            by = np.argsort(slot, kind="stable")
            cut = runs(slot[by])
            touched = slot[by][cut[:-1]]
            dw = np.add.reduceat((e * value)[by], cut[:-1]) + decay * w[touched]
            dv = np.add.reduceat(((e * value)[:, None] * (total[doc] - vx))[by], cut[:-1], axis=0) + decay * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate / 4 * dv / np.sqrt(gv[touched])
            gb += error.sum() ** 2
            bias -= rate * float(error.sum()) / gb**0.5
    return Machine(bias, w, v)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last, raw, offsets in chunks(b.column(0)):
            doc, slot, value = term_vectors(raw, offsets)
            at = np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value)), b.column(1)[first:last]], names=["slots", "amounts", "toxic"]
            )


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row, ``model``: the machine fitted on the sample."""
    sample = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    if docs.schema[id].dataType != labels.schema[id].dataType:  # ids of two types are equal where they are written alike
        docs, sample = docs.withColumn(id, F.col(id).cast("string")), sample.withColumn("_id", F.col("_id").cast("string"))
    texts = docs.select(F.col(id).alias("_doc"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_toxic")
    vectors = materialise(texts.mapInArrow(_vectors, "slots array<int>, amounts array<float>, toxic int"), "term-vectors")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            slots, amounts = b.column(0), b.column(1)
            at = slots.offsets.to_numpy()
            s, x = slots.values.to_numpy(), amounts.values.to_numpy()
            rows += [(s[i:j].copy(), x[i:j].copy()) for i, j in zip(at[:-1], at[1:])]
            y.append(b.column(2).to_numpy())
        labels_ = np.concatenate(y) if y else np.zeros(0)
        if 0 < labels_.sum() < len(labels_):
            order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes()))  # whatever order the rows came in
            yield pa.RecordBatch.from_arrays([pa.array([fit([rows[i] for i in order], labels_[order]).dump()], pa.binary())], names=["model"])

    return vectors.repartition(1).mapInArrow(learn, "model binary")


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic``."""
    row = materialise(train(docs, labels, text, id, label, sample_rows), "machine").first()
    shared = docs.sparkSession.sparkContext.broadcast(row.model if row else b"")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Machine.load(shared.value) if shared.value else None
        for texts in batches:
            out = np.zeros(len(texts))
            if machine:
                for first, last, raw, offsets in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
                    out[first:last] = machine.score(*term_vectors(raw, offsets), last - first)
            yield pd.Series(out)

    name, flag = fresh_name(docs, "toxicity"), fresh_name(docs, "toxic")
    return docs.withColumn(name, score(text)).withColumn(flag, (F.col(name) > threshold) & F.col(text).isNotNull() & (F.col(text) != ""))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic ones, columns as they were."""
    out = scored(docs, labels, text, id, label, sample_rows, threshold)
    return out.where(~F.col(out.columns[-1])).select(*docs.columns)
