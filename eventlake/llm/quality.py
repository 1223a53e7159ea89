"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 5).

P(grade <= g | text) = sigmoid(threshold_g - w . x).  All grades share the weights ``w`` of hashed text features; the
thresholds are ordered.  A document gets its expected grade and the
probability of at least the wanted grade, which selects it.

Features are present or absent: each word (lower-cased, bare of punctuation), the first four
letters of longer words, the punctuation that ends it, words in capitals, and bands of the share of repeated words and of words without letters, all hashed to ``BITS`` bits.

The model is fitted on the ``TRAIN_ROWS`` labelled documents with the least hash of their id (a documented bound), one row for each id, by proximal
gradient steps with an L1 penalty, so that only features with evidence keep a weight.  Scoring covers every document whole.

Contract: labels that are null or whose document is missing do not train; of a document's several labels
the lowest grade counts, of several documents of one id the least text.  Without any labels, or with one grade only, every document has that grade (the highest, without labels).  A null
text is "".  Each row gives one row, repeated rows too.  ``score_documents`` reads no other columns, ``keep_good`` returns all.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.rows import map_texts, slices

BITS = 22
TRAIN_ROWS = 8000
LEAST_DOCUMENTS = 4
STEPS = 250
L1 = 4e-4
CACHED = 400_000
CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def chunk_features(chunk: str) -> tuple[int, ...]:
    """Hashed features of a chunk without white space."""
    head, core, tail = CORE.match(chunk).groups()
    out = [_hash("w:" + core.lower())] if core else [_hash("p:" + chunk[:8])]
    if len(core) > 4:
        out.append(_hash("b:" + core[:4].lower()))
    if core and len(tail) > 1:
        out.append(_hash("t:" + tail[:4]))
    if core and head:
        out.append(_hash("h:" + head[:4]))
    if len(core) > 3 and core.isupper():
        out.append(_hash("caps"))
    return tuple(out)


def band_features(chunks: list[str], distinct: int) -> list[int]:
    """Bands of repetition, word length and length of a text."""
    n = len(chunks)
    if not n:
        return [_hash("empty")]
    bare = sum(not c.isalnum() for c in chunks)
    return [_hash(f"repeat:{int(10 * (1 - distinct / n))}:{min(n.bit_length(), 12)}"), _hash(f"bare:{int(10 * bare / n)}"), _hash(f"mean:{min(20, int(sum(map(len, chunks)) / n))}")]


def features(text: str) -> np.ndarray:
    chunks = text.split()
    distinct = set(chunks)
    return np.unique(np.array([f for c in distinct for f in chunk_features(c)] + band_features(chunks, len(distinct)), np.int64))


@dataclass
class OrdinalModel:
    """``thresholds``: one less than grades, ascending.  ``weights``: of the features that have one."""

    grades: list[int]
    thresholds: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    _chunks: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_chunks": {}}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        got = tuple(f for f in chunk_features(chunk) if f in self.weights)
        if len(chunk) <= 64:
            if len(self._chunks) >= CACHED:
                self._chunks.clear()
            self._chunks[chunk] = got
        return got

    def score(self, text: str) -> float:
        """w . x of a text."""
        chunks = text.split()
        distinct = set(chunks)
        present = set(band_features(chunks, len(distinct)))
        known = self._chunks
        for chunk in distinct:
            got = known.get(chunk)
            present.update(self._chunk(chunk) if got is None else got)
        get = self.weights.get
        return float(sum(sorted(get(f, 0.0) for f in present)))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) of each score, one column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)


def fit(rows: list[np.ndarray], grades: list[int], steps: int = STEPS, l1: float = L1) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty by accelerated proximal gradient steps; thresholds stay ordered."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return OrdinalModel(levels, np.empty(0))
    ids, where, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    used = seen >= LEAST_DOCUMENTS
    column = np.cumsum(used) - 1
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[used[where]]
    where = column[where[used[where]]]
    n, d = len(rows), int(used.sum())
    y = np.searchsorted(levels, grades)
    share = np.cumsum(np.bincount(y, minlength=len(levels)))[:-1] / n
    theta = np.log(share / (1 - share))
    w = np.zeros(d)
    # A feature's step is scaled by its curvature: rarer features may move further.
    curve = np.maximum(np.bincount(where, minlength=d) / n, 1 / n) * max(1.0, np.bincount(owner, minlength=n).mean()) ** 0.5
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    at, momentum = w.copy(), 1.0
    for _ in range(steps):
        s = np.bincount(owner, weights=at[where], minlength=n)
        high = np.where(y < len(theta), sigmoid(np.append(theta, 0)[np.minimum(y, len(theta))] - s), 1.0)
        low = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        slope = (dh - dl) / p / n  # of the loss, by s
        gradient = np.bincount(where, weights=slope[owner], minlength=d)
        by_theta = np.bincount(np.minimum(y, len(theta)), weights=-dh / p, minlength=len(theta) + 1)[: len(theta)] + np.bincount(y, weights=dl / p, minlength=len(theta) + 1)[1:]
        step = 1.0 / curve
        moved = at - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        if (gradient * (new - w)).sum() > 0:  # momentum points uphill: restart
            after = momentum = 1.0
        at, w, momentum = new + (momentum - 1) / after * (new - w), new, after
        theta = np.maximum.accumulate(theta - by_theta / n)
    kept = np.flatnonzero(w)
    return OrdinalModel(levels, theta, dict(zip(ids[used][kept].tolist(), w[kept].tolist())))


def train(documents: DataFrame, id_col: str, text_col: str, grades: DataFrame, grade_col: str, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """``grades``: id and grade.  At most ``rows`` labelled documents train, those with the least hash of their id."""
    labelled = grades.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).where("id is not null and grade is not null")
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = labelled.groupBy("id").agg(F.min("grade").alias("grade")).join(texts.select("id").distinct(), "id", "left_semi")
    chosen = found.orderBy(F.xxhash64("id"), "id").limit(rows)
    few = documents.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # bounded by ``rows``
    joined = texts.join(F.broadcast(few), "id").groupBy("grade", "id").agg(F.min("text").alias("text"))  # a row for each id

    def work():
        def step(keys, texts):
            return [*keys, pa.array([features(t) for t in texts], pa.list_(pa.int64()))]

        return step

    kind = dict(joined.dtypes)["id"]
    got = map_texts(joined, ["grade", "id"], "text", f"grade int, id {kind}, x array<long>", work).toArrow()
    ids, levels, x = got.column("id").to_pylist(), got.column("grade").to_pylist(), got.column("x").combine_chunks()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    if not order:
        return OrdinalModel([], np.empty(0))
    return fit([x[i].values.to_numpy() for i in order], [levels[i] for i in order])


def _judge(model: OrdinalModel, texts: list[str], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and probability of the wanted grade or more."""
    if len(model.grades) < 2:
        grade = model.grades[0] if model.grades else wanted
        return np.full(len(texts), float(grade)), np.full(len(texts), float(grade >= wanted))
    p = model.probabilities(np.array([model.score(t) for t in texts]))
    levels = np.array(model.grades)
    return p @ levels, p[:, levels >= wanted].sum(axis=1)


def score_documents(df: DataFrame, id_col: str, text_col: str, model: OrdinalModel, wanted: int, least: float = 0.5) -> DataFrame:
    """id, expected_grade, tail_probability, kept."""
    kind = dict(df.dtypes)[id_col]

    def work():
        def step(keys, texts):
            expected, tail = _judge(model, texts, wanted)
            return [keys[0], pa.array(expected), pa.array(tail), pa.array(tail >= least)]

        return step

    return map_texts(df, [id_col], text_col, f"k0 {kind}, expected_grade double, tail_probability double, kept boolean", work).withColumnRenamed("k0", id_col)


def keep_good(df: DataFrame, text_col: str, model: OrdinalModel, wanted: int, least: float = 0.5) -> DataFrame:
    """The rows whose tail probability reaches ``least``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, text_col):
                tail = _judge(model, [t or "" for t in few.column(text_col).to_pylist()], wanted)[1]
                yield few.filter(pa.array(tail >= least))

    return df.mapInArrow(run, df.schema)
