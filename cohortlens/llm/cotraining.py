"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other.

* Content view: distinct hashed words (lower case), their stems and endings, over the whole text. Metadata view: language, source and
  octave of the length, and their pairs. Both are naive Bayes over the presence of features that tell the classes apart
  significantly, so a round of training is one pass that counts documents by feature and class.
* Each round, every document without a label is scored by both views. Where one view is confident, its pseudo-label trains
  the *other* view in the next round, beside the true labels; pseudo-labels are drawn anew each round, so an early mistake
  does not stay.
* The log odds of a view are calibrated (Platt scaling) on labelled documents kept out of training, which also sets what
  "confident" means. The calibrated views are combined by a logistic regression on the same documents.

Two targets share the passes: quality and toxicity. A document is kept when it is more likely good than not and not toxic.

The model has ``BUCKETS`` + ``META_BUCKETS`` features; a task sums its counts before it emits them and only the summed counts
reach the driver. Calibration uses at most ``CALIBRATION_ROWS`` labelled rows (by hash of the id). All labelled rows train and
all documents are scored. The feature table is written once and read by every round.

Defined cases: null text and null metadata are values of their own; several labels of one id count as one (worst quality,
any toxicity), null labels are none; without labels, or with one class only, scores are the prior (0.5 without any label);
repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.hashing import SPACE, chunks, mix, prefix_hash, span_hash
from cohortlens.llm.tables import text_of, written

BUCKETS = 1 << 16
#: First bytes of a word that are a feature of their own.
STEM = 4
META_BUCKETS = 1 << 12
ROUNDS = 3
#: Odds by which a view must move the prior, and the least probability of its verdict, to teach the other view.
EVIDENCE, CONFIDENT = 19.0, 0.9
FOLDS = 5
CALIBRATION_ROWS = 20_000
#: Pseudo-counts of a feature; its rates in the two classes count if they lie so many standard deviations and such a factor
#: apart. The factor keeps out common words, whose presence tells little but the length, and that in many correlated copies.
SMOOTHING = 5.0
SIGNIFICANT, FACTOR = 4.0, {"content": 4.0, "metadata": 1.1}
TARGETS = ("quality", "toxic")
VIEWS = {"content": BUCKETS, "metadata": META_BUCKETS}


@dataclass
class Model:
    """Per view: feature weights and offset of each target, and the calibration (slope, offset); log odds of the targets."""

    weights: dict[str, np.ndarray]
    offset: dict[str, np.ndarray]
    scale: dict[str, np.ndarray]
    prior: np.ndarray


def _content(texts: list[bytes]) -> list[bytes]:
    """Distinct feature numbers of each text, two bytes each (``BUCKETS`` numbers)."""
    out = []
    for a, b in chunks(texts):
        raw = b" ".join([*texts[a:b], b""])
        data, lower = np.frombuffer(raw, np.uint8), np.frombuffer(raw.lower(), np.uint8)
        edge = np.diff(np.concatenate(([True], SPACE[data], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        bounds = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts[a:b]]]))
        words = span_hash(prefix_hash(lower), start, end)
        endings = span_hash(prefix_hash(data), np.maximum(end - 2, start), end) ^ np.uint64(1)
        stems = span_hash(prefix_hash(lower), start, np.minimum(start + STEM, end)) ^ np.uint64(2)
        for i in range(b - a):
            s = slice(bounds[i], bounds[i + 1])
            found = mix(np.concatenate([words[s], endings[s], stems[s]])) % np.uint64(BUCKETS)
            out.append(np.unique(found.astype(np.uint16)).tobytes())
    return out


def _features(batches):
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(_content(texts), pa.binary()), batch.column("metadata")],
            ["doc_id", "content", "metadata"],
        )


def feature_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content, metadata (feature numbers), quality, toxic (null without label), fold, order; written."""
    null = F.lit("\0")
    lang, source = (F.coalesce(F.col(c).cast("string"), null) for c in ("lang", "source"))
    size = F.coalesce(F.floor(F.log2(F.greatest(F.col("n_chars").cast("double"), F.lit(1.0)))).cast("string"), null)
    sets = [("l", lang), ("s", source), ("n", size), ("ls", F.concat_ws("|", lang, source)), ("ln", F.concat_ws("|", lang, size))]
    meta = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(k), v), F.lit(META_BUCKETS)).cast("int") for k, v in sets]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(docs).alias("text"), meta.alias("metadata")).mapInArrow(
        _features, f"doc_id {kind}, content binary, metadata array<int>"
    )
    one = labels.groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string"))
    # Always by shuffle: the label table grows with the corpus, so its broadcast would only help small inputs.
    rows = rows.join(one.hint("merge"), rows["doc_id"] == one["of"], "left").drop("of")
    return written(rows.withColumn("order", order).withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int")), "cotraining")


#: Documents whose features are looked up at once.
SLICE = 1_000


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, and where each row's begin and end."""
    if pa.types.is_binary(column.type):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        ids = np.frombuffer(data, np.uint16, (ends[-1] - ends[0]) // 2, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint16)
        return ids, (ends - ends[0]) // 2
    return column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _raw(batch: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    """Log odds of each view, a row per document and a column per target."""
    out = {}
    for view in VIEWS:
        ids, ends = _numbers(batch.column(view))
        sums = np.concatenate((np.zeros((1, len(TARGETS))), np.cumsum(model.weights[view][ids], axis=0)))
        out[view] = sums[ends[1:]] - sums[ends[:-1]] + model.offset[view]
    return out


def _label_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """True labels (documents x targets), -1 where there is none."""
    columns = [batch.column(t).fill_null(-1).to_numpy(zero_copy_only=False) for t in TARGETS]
    return np.stack(columns, 1).astype(np.int64)


def _count(batches, model: Model | None):
    """Documents by view, feature, target and class; feature -1 counts documents. Summed over the task."""
    total = {v: np.zeros((n + 1, len(TARGETS), 2), np.int64) for v, n in VIEWS.items()}
    for batch in _slices(batches):
        true = _label_matrix(batch)
        held = batch.column("fold").to_numpy() == 0
        teach = {v: np.where(held[:, None], -1, true) for v in VIEWS}
        if model is not None:
            raw = _raw(batch, model)
            for own, other in (("content", "metadata"), ("metadata", "content")):
                odds = raw[other] * model.scale[other][0] + model.scale[other][1]
                sure, moved = np.log(CONFIDENT / (1 - CONFIDENT)), odds - model.prior
                yes, no = (odds >= sure) & (moved >= np.log(EVIDENCE)), (odds <= -sure) & (moved <= -np.log(EVIDENCE))
                pseudo = np.where(yes, 1, np.where(no, 0, -1))
                teach[own] = np.where(true < 0, pseudo, teach[own])
        for view in VIEWS:
            ids, ends = _numbers(batch.column(view))
            sizes = np.diff(ends)
            for t in range(len(TARGETS)):
                for c in (0, 1):
                    of = teach[view][:, t] == c
                    total[view][:-1, t, c] += np.bincount(ids[np.repeat(of, sizes)], minlength=VIEWS[view])
                    total[view][-1, t, c] += int(of.sum())
    for view, counts in total.items():
        flat = counts.reshape(len(counts), -1)
        at = np.flatnonzero(flat.any(1))
        number = np.where(at == len(counts) - 1, -1, at).astype(np.int32)
        columns = [pa.array([view] * len(at)), pa.array(number), *[pa.array(flat[at, k]) for k in range(flat.shape[1])]]
        yield pa.record_batch(columns, ["view", "feature", *[f"c{k}" for k in range(flat.shape[1])]])


def train(rows: DataFrame, model: Model | None) -> Model:
    """Naive Bayes of both views from true labels and the pseudo-labels that ``model`` gives."""
    names = [f"c{k}" for k in range(2 * len(TARGETS))]
    kinds = "view string, feature int, " + ", ".join(f"{n} bigint" for n in names)
    counts = rows.mapInArrow(lambda b: _count(b, model), kinds)
    # At most BUCKETS + META_BUCKETS + 2 rows.
    found = counts.groupBy("view", "feature").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    view, feature = found.column("view").to_numpy(), found.column("feature").to_numpy()
    flat = np.stack([found.column(n).to_numpy() for n in names], 1) if len(found) else np.zeros((0, len(names)))
    weights, offset = {}, {}
    for v, n in VIEWS.items():
        table = np.zeros((n + 1, len(TARGETS), 2))
        own = view == v
        table[feature[own]] = flat[own].reshape(-1, len(TARGETS), 2)
        docs = table[-1]
        # Pseudo-counts in proportion to the classes draw rare features to no evidence, whichever class is larger.
        some = np.maximum(docs, 1)
        rate = table[:-1] / some + (SMOOTHING / some.sum(1))[:, None]
        overall = table[:-1].sum(2) / some.sum(1)
        deviation = np.sqrt(overall * (1 - overall) * (1 / some).sum(1)) + 1e-12
        clear = np.abs(table[:-1, :, 1] / some[:, 1] - table[:-1, :, 0] / some[:, 0]) >= SIGNIFICANT * deviation
        usable = (docs > 0).all(1)
        weight = np.log(rate[:, :, 1]) - np.log(rate[:, :, 0])
        weights[v] = np.where(usable & clear & (np.abs(weight) >= np.log(FACTOR[v])), weight, 0.0)
        offset[v] = np.where(usable, np.log(docs[:, 1] + 0.5) - np.log(docs[:, 0] + 0.5), 0.0)
    scale = {v: np.array([[1.0] * len(TARGETS), [0.0] * len(TARGETS)]) for v in VIEWS}
    return Model(weights, offset, scale, np.zeros(len(TARGETS)))


def _score_rows(batches, model: Model):
    for batch in _slices(batches):
        raw = _raw(batch, model)
        names = [f"{v}_{t}" for v in VIEWS for t in TARGETS]
        columns = [pa.array(raw[v][:, t]) for v in VIEWS for t in range(len(TARGETS))]
        yield pa.record_batch([batch.column(t) for t in TARGETS] + columns, [*TARGETS, *names])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients and offset (last) of a small logistic regression by Newton steps; targets are Platt's."""
    ones, n = float(y.sum()), len(y)
    if not n or ones in (0.0, float(n)):
        prior = (ones + 0.5) / (n + 1.0)
        return np.append(np.zeros(x.shape[1]), np.log(prior / (1 - prior)))
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - goal) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), gradient)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def calibrate(rows: DataFrame, model: Model) -> tuple[Model, dict[str, np.ndarray]]:
    """The model with calibrated views, and the combination (one coefficient per view, offset) of each target."""
    names = [f"{v}_{t}" for v in VIEWS for t in TARGETS]
    held = rows.filter((F.col("fold") == 0) & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    held = held.orderBy("order", "doc_id").limit(CALIBRATION_ROWS)
    kinds = ", ".join([f"{t} {rows.schema[t].dataType.simpleString()}" for t in TARGETS] + [f"{n} double" for n in names])
    found = held.mapInArrow(lambda b: _score_rows(b, model), kinds).toArrow()
    scale = {v: np.zeros((2, len(TARGETS))) for v in VIEWS}
    combination, prior = {}, np.zeros(len(TARGETS))
    for t, target in enumerate(TARGETS):
        y = found.column(target).fill_null(-1).to_numpy()
        own = y >= 0
        prior[t] = np.log((np.sum(y[own] == 1) + 0.5) / (np.sum(y[own] == 0) + 0.5))
        views = []
        for v in VIEWS:
            x = found.column(f"{v}_{target}").to_numpy()[own]
            scale[v][:, t] = logistic(x[:, None], y[own])
            views.append(x * scale[v][0, t] + scale[v][1, t])
        combination[target] = logistic(np.stack(views, 1), y[own])
    return Model(model.weights, model.offset, scale, prior), combination


def _final(batches, model: Model, combination: dict[str, np.ndarray]):
    for batch in _slices(batches):
        raw = _raw(batch, model)
        calibrated = {v: raw[v] * model.scale[v][0] + model.scale[v][1] for v in VIEWS}
        chance = lambda z: pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        columns = [batch.column("doc_id")]
        columns += [chance(calibrated[v][:, 0]) for v in VIEWS]
        for t, target in enumerate(TARGETS):
            w = combination[target]
            columns.append(chance(sum(w[k] * calibrated[v][:, t] for k, v in enumerate(VIEWS)) + w[-1]))
        yield pa.record_batch(columns, ["doc_id", "content_score", "metadata_score", "score", "toxic_score"])


def cotrained_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, content_score, metadata_score, score (chance of good quality), toxic_score, kept: every document."""
    rows = feature_table(docs, labels)
    model, combination = calibrate(rows, train(rows, None))
    for _ in range(rounds):
        model, combination = calibrate(rows, train(rows, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", *VIEWS).mapInArrow(
        lambda b: _final(b, model, combination),
        f"doc_id {kind}, content_score double, metadata_score double, score double, toxic_score double",
    )
    return scored.withColumn("kept", (F.col("score") >= 0.5) & (F.col("toxic_score") < 0.5))
