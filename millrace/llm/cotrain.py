"""Quality classifier by co-training.

Two views of a document: its text content (which words and marks it has) and its page metadata (language, source, size,
and the shape of its lines and characters). A logistic classifier for each view is trained on a bounded sample of
labelled documents. Labels are dealt to folds: classifiers trained without a fold score it, and by those scores both views are
calibrated and weighed into one probability. In each round both views score all unlabelled documents, in one pass over the
corpus; each gives the other those that it is most confident of by its calibrated probability, as pseudo-labels that weigh
less than labels, and both are trained and calibrated anew.

Good means a label quality = 1 and toxic = 0, so the classifier rejects junk and toxic text. Documents with equal text and
metadata are one document here, so a group of copies is one label. What is fitted on is bounded by `labelled` documents,
chosen by a hash, and by `pseudo` documents for each view and round, the most confident of all; scoring reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, forget, pieces, releasing, saved, text_bytes

#: Buckets that words are hashed to; buckets of the metadata's categories.
WIDTH, KINDS = 1 << 17, 64
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_UPPER, _DIGIT, _HIGH = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58], _HIGH[128:] = True, True, True
_SHAPE = 9
META = _SHAPE + 2 * KINDS


def text_view(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each distinct word and each distinct run of marks."""
    out = []
    for delimiters in (~_ALNUM, _ALNUM | WHITE):
        words = Words(buf, offsets, lower=True, delimiters=delimiters)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        out.append((doc.astype(np.uint64) << np.uint64(20)) | (words.hashes() & np.uint64(WIDTH - 1)))
    both = np.unique(np.concatenate(out))
    return (both >> np.uint64(20)).astype(np.int64), (both & np.uint64(WIDTH - 1)).astype(np.int64)


def meta_view(buf: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """A row for each document: size, line and character shares, and one-hot buckets of language and source."""
    size = np.diff(offsets)

    def count(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    n, lines = np.maximum(size, 1), count(buf == 10) + 1
    white = count(WHITE[buf])
    shape = [np.log1p(size), np.log(lines), np.log1p(size / lines), count(_UPPER[buf]) / n, count(_DIGIT[buf]) / n, count(_HIGH[buf]) / n, white / n, count(~(_ALNUM | WHITE)[buf]) / n, np.log1p(size / (white + 1))]
    out = np.zeros((len(size), META), np.float32)
    out[:, :_SHAPE] = np.array(shape).T
    for k, column in enumerate((lang, source)):
        words = Words(*text_bytes(column), delimiters=np.zeros(256, bool))
        has = np.flatnonzero(np.diff(words.bounds))
        out[has, _SHAPE + k * KINDS + (words.hashes() % np.uint64(KINDS)).astype(np.int64)] = 1
    return out


def _weights(y: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """What each document weighs: its trust, and both classes the same in sum."""
    return trust * np.where(y > 0, 0.5 / max((trust * y).sum(), 1e-9), 0.5 / max((trust * (1 - y)).sum(), 1e-9))


def _stretches(rows: list[np.ndarray], most: int = 1 << 17):
    """Stretches of rows with about `most` entries, one row at least: the slice of rows, their sizes and their entries. What a fit in the driver computes for each entry it holds for one stretch at a time."""
    size = np.cumsum([len(r) for r in rows])
    first, done = 0, 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(size, done + most, "right")))
        some = rows[first:last]
        yield slice(first, last), np.array([len(r) for r in some]), np.concatenate(some)
        first, done = last, size[last - 1]


@dataclass
class TextModel:
    weights: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, trust: np.ndarray, steps: int = 60, rate: float = 0.2, l2: float = 1e-4) -> TextModel:
        """Presence of a bucket, scaled by how much more often one class has it, then logistic weights."""
        good, bad = np.zeros(WIDTH), np.zeros(WIDTH)
        for some, sizes, bucket in _stretches(rows):
            for total, c in ((good, y), (bad, 1 - y)):
                total += np.bincount(bucket, weights=np.repeat((trust * c)[some], sizes), minlength=WIDTH)
        ratio = np.log((good + 1) / ((trust * y).sum() + 2)) - np.log((bad + 1) / ((trust * (1 - y)).sum() + 2))
        ratio[good + bad < min(4, len(rows) / 20)] = 0
        use = np.flatnonzero(ratio)
        value, place = ratio[use], np.zeros(WIDTH, np.int32)
        place[use] = np.arange(len(use))
        slots = list(_stretches([place[r[ratio[r] != 0]] for r in rows]))
        weight = _weights(y, trust)
        w, m, v = np.zeros(len(use) + 1), 0.0, 0.0
        for t in range(1, steps + 1):  # gradient steps with adaptive rates
            scaled, g = w[:-1] * value, np.zeros(len(use) + 1)
            for some, sizes, slot in slots:
                odds = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=scaled[slot], minlength=len(sizes)) + w[-1]
                off = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[some]) * weight[some]
                g[:-1] += np.bincount(slot, weights=np.repeat(off, sizes), minlength=len(use))
                g[-1] += off.sum()
            g[:-1] *= value
            g += l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        out = np.zeros(WIDTH + 1)
        out[use], out[-1] = w[:-1] * ratio[use], w[-1]
        return cls(out)

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, weights=self.weights[bucket], minlength=n) + self.weights[-1]

    def of(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self.score(np.repeat(np.arange(len(sizes)), sizes), bucket, len(sizes)) for _, sizes, bucket in _stretches(rows)])


@dataclass
class MetaModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _wide(x):
        s = x[:, :_SHAPE]
        return np.hstack([s, s**2, x[:, _SHAPE:], np.ones((len(x), 1))])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trust: np.ndarray) -> MetaModel:
        x = np.asarray(x, np.float64)
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        mean[_SHAPE:], spread[_SHAPE:] = 0, 1
        z = cls._wide(np.clip((x - mean) / spread, -6, 6))
        return cls(mean, spread, _newton(z, y, _weights(y, trust), 1e-3))

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._wide(np.clip((x - self.mean) / self.spread, -6, 6)) @ self.weights


def _squashed(score: np.ndarray) -> np.ndarray:
    """A long text has a large score either way, which would bend a straight line of log-odds."""
    return np.arcsinh(score)


@dataclass
class Model:
    """Two views, the calibration (slope, offset) of each one's squashed score, and how their log-odds are weighed: text, metadata, offset."""

    text: TextModel
    meta: MetaModel
    calibration: list[tuple[float, float]]
    mixing: np.ndarray

    def odds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both views' scores as calibrated log-odds."""
        return tuple(np.clip(p * _squashed(x) + q, -30, 30) for (p, q), x in zip(self.calibration, (a, b), strict=True))

    def combine(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good by text, by metadata, by both."""
        a, b = self.odds(a, b)
        both = np.clip(self.mixing[0] * a + self.mixing[1] * b + self.mixing[2], -30, 30)
        return tuple(1 / (1 + np.exp(-x)) for x in (a, b, both))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Logistic weights of a few columns, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * (p * (1 - p) + 1e-9))) @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _platt(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logistic weights of scores and an offset; classes by their true frequency."""
    return _newton(np.column_stack([*columns, np.ones(len(y))]), y, np.ones(len(y)), 1e-3)


def _models(views: dict[int, tuple[np.ndarray, np.ndarray]], labels: dict[int, int], given: list[dict[int, int]], trust: float) -> tuple[TextModel, MetaModel]:
    """Both views' classifiers, each trained on the labels (key -> 1 or 0) and on its own pseudo-labels, which weigh `trust` each."""
    out = []
    for kind, own, of in ((TextModel, given[0], 0), (MetaModel, given[1], 1)):
        told = labels | own
        out.append(kind.fit([views[k][of] for k in told], np.array(list(told.values()), float), np.array([trust if k in own else 1.0 for k in told])))
    return tuple(out)


def _folds(labels: dict[int, int], n: int) -> list[list[int]]:
    """The keys dealt to n folds, each class evenly."""
    out: list[list[int]] = [[] for _ in range(n)]
    for c in (0, 1):
        for i, k in enumerate(k for k, label in labels.items() if label == c):
            out[i % n].append(k)
    return [f for f in out if f]


def fitted(views, labels: dict[int, int], given: list[dict[int, int]], trust: float, folds: int) -> Model:
    """The model of all labels and pseudo-labels. Each fold of the labels is scored by classifiers that were trained without it, so calibration sees no label twice."""
    a, b, y = [], [], []
    for fold in _folds(labels, folds):
        out = set(fold)
        text, page = _models(views, {k: v for k, v in labels.items() if k not in out}, given, trust)
        a.append(text.of([views[k][0] for k in fold]))
        b.append(page.of(np.array([views[k][1] for k in fold], np.float64)))
        y += [labels[k] for k in fold]
    scores, y = (np.concatenate(a), np.concatenate(b)), np.array(y, float)
    model = Model(*_models(views, labels, given, trust), [tuple(_platt([_squashed(x)], y)) for x in scores], np.zeros(3))
    model.mixing = _platt(list(model.odds(*scores)), y)
    return model


def _views(batches):
    """key, label, text, lang, source -> key, label, buckets, meta."""
    for batch in batches:
        for piece in pieces(batch, 2):
            buf, offsets = text_bytes(piece.column(2))
            doc, bucket = text_view(buf, offsets)
            at = np.searchsorted(doc, np.arange(len(offsets)))
            meta = meta_view(buf, offsets, piece.column(3), piece.column(4))
            yield pa.record_batch({
                "key": piece.column(0), "label": piece.column(1), "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                "meta": pa.array([m.tobytes() for m in meta], pa.binary()),
            })


def _seen(keyed: DataFrame, some: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """key -> label, buckets, meta of the documents in `some` (key, label: a bounded number), one row for each key, in order of key."""
    one = keyed.join(F.broadcast(some), "key").dropDuplicates(["key"]).select("key", "label", "text", "lang", "source")
    rows = one.mapInArrow(releasing(_views), "key long, label int, buckets binary, meta binary").collect()
    return {r["key"]: (r["label"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["meta"], np.float32)) for r in sorted(rows)}


def _scored(keyed: DataFrame, model: Model) -> DataFrame:
    """key, a, b: both views' calibrated log-odds of each distinct document."""
    shared = keyed.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        m = shared.value
        for batch in batches:
            for piece in pieces(batch, 1):
                buf, offsets = text_bytes(piece.column(1))
                a, b = m.text.score(*text_view(buf, offsets), piece.num_rows), m.meta.of(meta_view(buf, offsets, piece.column(2), piece.column(3)))
                yield pa.record_batch({"key": piece.column(0), **dict(zip("ab", map(pa.array, m.odds(a, b)), strict=True))})

    rows = keyed.select("key", "text", "lang", "source").mapInArrow(releasing(scored), "key long, a double, b double")
    return rows.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def confident(scores: DataFrame, share: float, most: int, sure: float, taken: list[set[int]]) -> list[dict[int, int]]:
    """What each view gets from the other: key -> label of the at most `most` documents that the giver is surest of, over `sure`, without those taken.

    scores: key, a, b (calibrated log-odds of the text view and of the metadata view). share: that of good ones among them.
    """
    out: list[dict[int, int]] = [{}, {}]
    least = float(np.log(sure / (1 - sure)))
    for taker, giver in ((0, "b"), (1, "a")):
        for label, odds, n in ((1, F.col(giver), round(most * share)), (0, -F.col(giver), most - round(most * share))):
            best = scores.where(odds >= least).orderBy(odds.desc(), F.xxhash64("key"), "key").limit(n + len(taken[taker])).select("key")
            new = [r["key"] for r in best.collect() if r["key"] not in taken[taker] and r["key"] not in out[taker]]
            out[taker] |= dict.fromkeys(new[:n], label)
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = 8_000, pseudo: int = 2_000, rounds: int = 2, sure: float = 0.95, trust: float = 0.25, folds: int = 3) -> Model | None:
    """Co-train on at most `labelled` labelled documents, the first by a hash, and `pseudo` others for each view and round. None if a class has fewer than two labels."""
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int") * (1 - F.coalesce("toxic", F.lit(0))).cast("int")).alias("label"))
    keyed = docs.select("doc_id", "text", *[F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")])
    keyed = keyed.withColumn("key", F.xxhash64("text", "lang", "source"))
    known = saved(keyed.select("doc_id", "key").join(told, "doc_id").groupBy("key").agg(F.min("label").alias("label")), "quality_labels")
    seen = _seen(keyed, known.orderBy(F.xxhash64("key"), "key").limit(labelled))
    y = {k: label for k, (label, _, _) in seen.items()}
    if min(sum(v == c for v in y.values()) for c in (0, 1)) < 2:
        return None
    views = {k: x[1:] for k, x in seen.items()}
    given: list[dict[int, int]] = [{}, {}]
    model = fitted(views, y, given, trust, folds)
    for _ in range(rounds):
        scores = saved(_scored(keyed, model).join(known.select("key"), "key", "left_anti"), "quality_scores")
        new = confident(scores, float(np.mean(list(y.values()))), pseudo, sure, [set(g) for g in given])
        forget(scores)
        if not any(new):
            break
        if fetch := [(k, 0) for k in sorted({*new[0], *new[1]} - views.keys())]:
            views |= {k: x[1:] for k, x in _seen(keyed, docs.sparkSession.createDataFrame(fetch, "key long, label int")).items()}
        given = [g | n for g, n in zip(given, new, strict=True)]
        model = fitted(views, y, given, trust, folds)
    forget(known)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """docs and p_text, p_meta, p_quality (double, probabilities of good by text, by metadata, by both) and keep (boolean).

    docs needs doc_id and text, and may have lang and source; labels needs doc_id, quality, toxic. A null text counts as
    empty. Several labels of a document count as the worst; null ones don't count. Without two labels of either class
    nothing can be learned: probabilities are null and all is kept. Columns named like the results are replaced. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    result = ["p_text", "p_meta", "p_quality", "keep"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in result])
    model = train(docs, labels, **bounds)
    if model is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(c) for c in result[:3]], F.lit(True).alias("keep"))
    shared, names = spark.sparkContext.broadcast(model), docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "p_text double, p_meta double, p_quality double, keep boolean"])

    def score(batches):
        m = shared.value
        for batch in batches:
            for piece in pieces(batch, names.index("text")):
                column = lambda c: piece.column(names.index(c)).cast(pa.string()) if c in names else pa.nulls(piece.num_rows, pa.string())  # noqa: B023, E731
                buf, offsets = text_bytes(column("text"))
                a, b = m.text.score(*text_view(buf, offsets), piece.num_rows), m.meta.of(meta_view(buf, offsets, column("lang"), column("source")))
                p = m.combine(a, b)
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(x) for x in p), pa.array(p[2] >= threshold)], names=[*names, *result])

    return docs.mapInArrow(releasing(score), schema)
