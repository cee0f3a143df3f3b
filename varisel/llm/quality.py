"""Ordinal cumulative-link regression over hashed text features.

P(grade <= k) = logistic(cut_k - w.x): one weight vector for all grades, ordered cuts. x has a 1 for each hashed
word and beginning of a word, each run of punctuation behind a word and each shape bucket (share of repeated neighbours, of
capitals, of words with punctuation runs) that a text has. Weights are fitted with an L1 penalty by
proximal gradient steps, so features that tell nothing weigh exactly zero and long texts gather
no noise. Expected grade and tail probability P(grade >= top) follow for every whole text; ``select`` keeps
those whose tail probability reaches ``threshold``.

Fitting uses at most ``max_rows`` labelled rows (default 20,000), the smallest hashes of doc_id; scoring
takes all rows, in tasks, with the weights (DIMENSIONS floats) sent to each.

Grades here: 0 toxic, 1 of low quality, 2 clean. Defined cases: rows without doc_id, quality or toxic are
no labels; several labels of a document count as their lowest grade; of documents with a repeated doc_id the
one of the smallest text hash is fitted; null text is the empty text; with fewer than two grades among the labels nothing can be
learned, all documents are kept and their scores are null; other columns are passed on by ``select``."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, parts_of

DIMENSIONS = 1 << 18
#: Training rows from which the penalty is as given.
ENOUGH_ROWS = 2_500
#: Rows that a step of the fit takes at once, so that the driver holds the features (4 bytes each) and little more.
FIT_ROWS = 1_000
#: Forms that a task remembers, about 300 bytes each; affects speed only.
CACHE = 50_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCORES = ("expected_grade", "p_top")


def _id(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % DIMENSIONS


def _forms(s: str) -> tuple[int, int, int, bool]:
    """Features of one blank-separated chunk: word, beginning, run of punctuation (-1: none); capitals."""
    head = s.rstrip(PUNCTUATION)
    core = head.lstrip(PUNCTUATION)
    tail = s[len(head) :]
    word = core.lower()
    return _id("w " + word), _id("b " + word[:5]) if len(word) > 5 else -1, _id("p " + tail) if len(tail) > 1 or not core else -1, len(core) > 2 and core.isupper()


def text_features(texts: pa.Array, cache: dict[str, tuple[int, int, int, bool]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct, in order of rows."""
    cache = {} if cache is None else cache
    texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    per = pc.list_value_length(lists).to_numpy().astype("i8")
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    if len(cache) > CACHE:
        cache.clear()
    forms = [cache.get(s) for s in names]
    for i, (s, f) in enumerate(zip(names, forms, strict=True)):
        if f is None:
            forms[i] = f = _forms(s)
            if len(s) <= 48:
                cache[s] = f
    word, begin, tail, caps = (np.array([f[k] for f in forms], "i8") for k in range(4))
    row = np.repeat(np.arange(len(texts)), per)
    n = np.maximum(per, 1)
    same = np.zeros(len(which), "i8")
    same[1:] = (which[1:] == which[:-1]) & (row[1:] == row[:-1])
    shares = {"same": same, "caps": caps[which], "runs": (tail[which] >= 0).astype("i8")}
    extra = []
    for name, on in shares.items():
        share = np.bincount(row, on, len(texts)) / n
        bucket = np.searchsorted([0.0, 0.02, 0.1, 0.3, 0.6], share, "left")
        extra.append(np.array([_id(f"s {name} {b}") for b in range(6)], "i8")[bucket])
    all_rows = np.concatenate([row, row, row, *[np.arange(len(texts))] * 3])
    all_features = np.concatenate([word[which], begin[which], tail[which], *extra])
    pairs = np.unique((all_rows * DIMENSIONS + all_features)[all_features >= 0])
    return pairs // DIMENSIONS, pairs % DIMENSIONS


@dataclass
class CumulativeLink:
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """P(grade = k) for each row."""
        score = np.bincount(rows, self.weights[features], n)
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -40, 40)))
        return np.diff(np.column_stack([np.zeros(n), below, np.ones(n)]), axis=1)


def fit(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, least_rows: int = 5, penalty: float = 6e-4, steps: int = 300) -> CumulativeLink | None:
    """Proximal gradient steps at rates of their own for each weight; the cuts are kept apart by fitting the
    logarithms of their distances. Few rows need a stronger penalty: under ENOUGH_ROWS it grows as the noise of
    a mean does, with the root of their number."""
    n, top = len(grades), int(grades.max(initial=0))
    penalty *= max(1.0, (ENOUGH_ROWS / max(n, 1)) ** 0.5)
    if len(np.unique(grades)) < 2:
        return None
    seen = np.bincount(features, minlength=DIMENSIONS)
    kept = np.flatnonzero(seen >= least_rows)
    place = np.full(DIMENSIONS, -1, "i4")
    place[kept] = np.arange(len(kept))
    on = place[features] >= 0
    r, f = rows[on].astype("i4"), place[features[on]]
    cuts_at = np.searchsorted(r, np.arange(0, n + FIT_ROWS, FIT_ROWS))
    parts = [(i * FIT_ROWS, min((i + 1) * FIT_ROWS, n), r[x:y], f[x:y]) for i, (x, y) in enumerate(zip(cuts_at, cuts_at[1:], strict=False))]
    shares = np.clip(np.bincount(grades, minlength=top + 1).astype(float), 0.5, None) / n
    first = np.cumsum(shares)[:-1].clip(1e-3, 1 - 1e-3)
    cuts = np.log(first / (1 - first))
    gaps = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    w = np.zeros(len(kept))
    grad2_w, grad2_g = np.full(len(kept), 1e-8), np.full(len(gaps), 1e-8)
    for _ in range(steps):
        cuts = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
        score = np.concatenate([np.bincount(pr - x, w[pf], y - x) for x, y, pr, pf in parts])
        s = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -40, 40)))
        full = np.column_stack([np.zeros(n), s, np.ones(n)])
        slope = np.column_stack([np.zeros(n), s * (1 - s), np.zeros(n)])
        i = np.arange(n)
        p = np.maximum(full[i, grades + 1] - full[i, grades], 1e-9)
        d_score = (slope[i, grades + 1] - slope[i, grades]) / p / n  # of the mean negative log likelihood
        g_w = sum(np.bincount(pf, d_score[pr], len(kept)) for _, _, pr, pf in parts)
        d_cut = np.zeros(top)
        for k in range(top):
            d_cut[k] = (-slope[:, k + 1] / p * (grades == k) + slope[:, k + 1] / p * (grades == k + 1)).sum() / n
        g_g = np.concatenate([[d_cut.sum()], np.exp(gaps[1:]) * np.cumsum(d_cut[::-1])[::-1][1:]])
        grad2_w += g_w**2
        grad2_g += g_g**2
        rate = 0.5 / np.sqrt(grad2_w)
        w = w - rate * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        gaps = gaps - 0.5 / np.sqrt(grad2_g) * g_g
    out = np.zeros(DIMENSIONS)
    out[kept] = w
    return CumulativeLink(out, np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))]))


def grades(labels: DataFrame) -> DataFrame:
    """label_id, grade (0 toxic, 1 low quality, 2 clean): one row for each labelled document."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> CumulativeLink | None:
    """Fit on at most ``max_rows`` labelled rows."""
    sample = grades(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            data: list[bytes] = []
            for a, b in parts_of(batch.column("text")):
                r, f = text_features(batch.column("text").slice(a, b - a), cache)
                cuts = np.searchsorted(r, np.arange(b - a + 1))
                data += [f[x:y].astype("<i4").tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("grade"), pa.array(data, pa.binary())], names=["label_id", "grade", "features"])

    met = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    one = met.groupBy("label_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    got = one.select("label_id", "x.text", "grade").mapInArrow(lean(task), "label_id long, grade int, features binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("label_id")
    data = got.column("features").to_pylist()
    lengths = np.array([len(x) // 4 for x in data])
    features, known = np.frombuffer(b"".join(data), "<i4"), got.column("grade").to_numpy().astype("i8")
    del data, got
    model = fit(np.repeat(np.arange(len(lengths), dtype="i4"), lengths), features, known)
    del features
    give_back()  # the driver's other stages would stand beside it
    return model


def score(docs: DataFrame, model: CumulativeLink | None) -> DataFrame:
    """``docs`` with expected_grade and p_top, in place of columns of these names."""
    names = [c for c in docs.columns if c not in SCORES]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    if model is None:
        return kept.withColumns({c: F.lit(None).cast("double") for c in SCORES})
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype("f4"), model.cuts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = CumulativeLink(*sent.value), {}
        for batch in batches:
            texts = batch.column(names.index("text"))
            p = np.concatenate([own.probabilities(*text_features(texts.slice(a, b - a), cache), b - a) for a, b in parts_of(texts)] or [np.zeros((0, len(own.cuts) + 1))])
            expected = p @ np.arange(p.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(p[:, -1])], names=[*names, *SCORES])

    schema = kept.withColumns({c: F.lit(0.0) for c in SCORES}).schema
    return kept.mapInArrow(lean(task), schema)


def select(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """The documents whose P(grade >= top) reaches ``threshold``, with their scores."""
    scored = score(docs, train(docs, labels, max_rows))
    return scored.filter(F.col("p_top").isNull() | (F.col("p_top") >= threshold))
