"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line of a text is a node with two labels, good and bad. Its features are shares of byte classes, word length, repetition
and length, of the line itself and of the lines before and after it; a 2x2 table scores neighbouring labels. The model is trained on
segments of the labelled documents (each line carries its document's label) by the exact gradient of the log-likelihood from
forward-backward passes. A document's quality is the mean of its lines' marginals for `good`, weighted by their bytes plus 1, and a
logistic function fitted on the same sample turns it into the score.

The model is fitted on a sample: at most `SAMPLE_DOCS` labelled documents, those with the smallest hashes of their ids, but a tenth
of that of each label where there are so many; and at most `SAMPLE_LINES` of their lines, in that order: a document that does not fit is skipped, one of over
`DOC_LINES` lines gives so many in evenly spaced segments, and no label takes the last tenth of the lines from the other. An id that has several
rows trains once, by the least of their texts. Lines are counted first; only features of the lines that fit go to the driver, 19 MB at most, and
nothing else does. As every line carries its document's label, training sees equal neighbours only and would let the chain's scores grow without end: they are kept within
-3 and 3 after each step. Scoring is one narrow pass over all whole texts. Labels, language, source and id are never features.

Defined cases. A null or empty text is one empty line and gets a score as any other. A null id is not held out and
never trains. Repeated rows are scored one by one. Null labels are left out; of several labels of an id the smallest counts. With labels of
one kind only, or none, every score is (n1 + 1) / (n + 2) for n1 labels 1 among n sampled documents; there is a warning if only the sampled
documents lack a kind. Empty tables: no rows. Other columns of any name stay; only those called as the new ones are (`names`) give way to them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import materialise, private, without

SAMPLE_DOCS = 4000
SAMPLE_LINES = 120_000
DOC_LINES = 2048
#: Lines of a training segment, steps of the optimiser, weight of the penalty.
SEGMENT, STEPS, PENALTY = 32, 120, 1e-4
#: Bytes of text that are looked at together (or one longer text).
PART = 1 << 20
#: Byte classes in order; every other byte is of class 0.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"*#$%&@~^+=<>", b"|", b"!?", b".,;:'\"()-", bytes(range(128, 256)))
UP, LOW, DIGIT, SPACE, SYMBOL, BAR, SHOUT, MARK, WIDE = range(1, 10)
OWN = 13
FEATURES = 1 + OWN + 2 * OWN
SCORED = "score double, predicted int"


def class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for number, members in enumerate(CLASSES, 1):
        table[list(members)] = number
    return table


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights (bytes + 1), and the number of lines of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins
    line = np.repeat(np.arange(len(ends)), sizes + 1)
    kinds = class_table()[raw]
    counts = np.bincount(line * 10 + kinds, minlength=len(ends) * 10).reshape(-1, 10).astype(np.float64)
    counts[:, 0] -= 1  # the line feed
    blank = (kinds == SPACE) | (raw == 10)
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    word_line = line[first]
    with np.errstate(over="ignore"):
        power = np.arange(1, len(raw) + 1, dtype=np.uint64)
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        weighted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power, dtype=np.uint64)])
        total = sums[last] - sums[first]
        keys = total * np.uint64(0xBF58476D1CE4E5B9) + (weighted[last] - weighted[first] - total * first.astype(np.uint64))
    same = np.zeros(len(first), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (word_line[1:] == word_line[:-1])
    words = np.bincount(word_line, minlength=len(ends)).astype(np.float64)
    repeats = np.bincount(word_line[same], minlength=len(ends)).astype(np.float64)
    some, letters, tokens = np.maximum(sizes, 1), np.maximum(counts[:, UP] + counts[:, LOW], 1), np.maximum(words, 1)
    own = np.column_stack([counts[:, UP] / letters, counts[:, DIGIT] / some, counts[:, SPACE] / some, np.minimum(counts[:, SYMBOL] / tokens, 4), np.minimum(counts[:, BAR] / tokens, 1), np.minimum(counts[:, SHOUT] / tokens, 3), counts[:, MARK] / some, counts[:, WIDE] / some, counts[:, 0] / some, repeats / tokens, np.minimum(sizes / tokens, 40) / 10, np.log1p(sizes) / 10, sizes == 0])
    per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    heads = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[heads] = 0
    after[heads + per_text - 1] = 0
    return np.column_stack([np.ones(len(ends)), own, before, after]).astype(np.float32), (sizes + 1).astype(np.float64), per_text


@dataclass
class Model:
    """Weights of the log-odds of `good`, scores of neighbouring labels [from, to] (bad, good), and the logistic scale."""

    weights: np.ndarray
    chain: np.ndarray
    scale: float
    offset: float

    def marginals(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """P(good) of every line by forward and backward odds."""
        odds = np.exp(np.clip(features.astype(np.float64) @ self.weights, -30, 30))
        (bb, bg), (gb, gg) = np.exp(self.chain).tolist()
        out, at = np.empty(len(odds)), 0
        for size in per_text.tolist():
            own = odds[at : at + size].tolist()
            forward, held = [], 1.0
            for i, o in enumerate(own):
                held = o if i == 0 else o * (held * gg + bg) / (held * gb + bb)
                held = min(max(held, 1e-12), 1e12)
                forward.append(held)
            back = 1.0
            for i in range(size - 1, -1, -1):
                both = forward[i] * back
                out[at + i] = both / (1 + both)
                beyond = own[i] * back
                back = min(max((gg * beyond + gb) / (bg * beyond + bb), 1e-12), 1e12)
            at += size
        return out

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * quality + self.offset, -500, 500)))


def qualities(model: Model, features: np.ndarray, weights: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Length-weighted means of the marginals."""
    marginals, heads = model.marginals(features, per_text), np.concatenate([[0], np.cumsum(per_text)[:-1]])
    return np.add.reduceat(marginals * weights, heads) / np.add.reduceat(weights, heads)


def _expectations(scores: np.ndarray, chain: np.ndarray, mask: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of `good`, expected label pairs (each segment's times its balance) and log partition functions of padded segments,
    by forward-backward in log space."""
    n, length = scores.shape
    node = np.stack([np.zeros_like(scores), scores], axis=2)
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0] = node[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, :1] + chain[0], alpha[:, t - 1, 1:] + chain[1]) + node[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = beta[:, t + 1] + node[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + chain[:, 0], ahead[:, 1:] + chain[:, 1])
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]) * mask
    pairs = np.zeros((2, 2))
    inner = mask[:, 1:]
    for a in range(2):
        for b in range(2):
            each = np.exp(alpha[:, :-1, a] + chain[a, b] + node[:, 1:, b] + beta[:, 1:, b] - log_z[:, None]) * inner
            pairs[a, b] = balance @ each.sum(axis=1)
    return good, pairs, log_z


def likelihood(weights: np.ndarray, chain: np.ndarray, flat: np.ndarray, mask: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the segments, each times its balance, less the penalty; and its gradient (weights, then chain)."""
    scores = np.zeros(mask.shape)
    scores[mask] = flat @ weights
    good, pairs, log_z = _expectations(scores, chain, mask, balance)
    error = (labels[:, None] * mask - good) * balance[:, None]
    steps = mask[:, 1:].sum(axis=1)
    observed = np.diag([balance[labels == label] @ steps[labels == label] for label in (0, 1)])
    held = labels * scores.sum(axis=1) + steps * chain[labels, labels] - log_z
    beta = np.concatenate([weights, chain.reshape(-1)])
    gradient = np.concatenate([error[mask] @ flat, (observed - pairs).reshape(-1)]) / len(labels) - PENALTY * beta
    return float(balance @ held) / len(labels) - PENALTY / 2 * float(beta @ beta), gradient


def train(samples: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """A model from (label, line features, line weights) of documents. Without both labels it gives every text the rate of label 1
    among n sampled documents, (n1 + 1) / (n + 2)."""
    labels = [label for label, _, _ in samples]
    if len(set(labels)) < 2:
        rate = (sum(labels) + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    segments = [(label, f[i : i + SEGMENT]) for label, f, _ in samples for i in range(0, len(f), SEGMENT)]
    longest = max(len(f) for _, f in segments)
    mask = np.arange(longest) < np.array([len(f) for _, f in segments])[:, None]
    flat = np.concatenate([f for _, f in segments]).astype(np.float64)  # the lines, as `mask` has them row by row
    labels = np.array([label for label, _ in segments])
    goods = sum(label for label, _, _ in samples) / len(samples)
    balance = np.where(labels == 1, 0.5 / goods, 0.5 / (1 - goods)) / mask.sum(axis=1)  # both labels, and all documents, weigh the same
    weights, chain = np.zeros(FEATURES), np.zeros((2, 2))
    first, second = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, STEPS + 1):
        _, gradient = likelihood(weights, chain, flat, mask, labels, balance)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights += move[:FEATURES]
        chain = np.clip(chain + move[FEATURES:].reshape(2, 2), -3, 3)
    model = Model(weights, chain, 1.0, 0.0)
    quality = qualities(model, np.concatenate([f for _, f, _ in samples]), np.concatenate([w for _, _, w in samples]), np.array([len(f) for _, f, _ in samples]))
    model.scale, model.offset = logistic(quality, np.array([label for label, _, _ in samples], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a penalised logistic regression, by Newton's method."""
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(id_col: str) -> Column:
    """The fold that never trains: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > PART:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _spaced(lines: int) -> np.ndarray:
    """The lines of a document that train: all, or evenly spaced segments of DOC_LINES in all."""
    if lines <= DOC_LINES:
        return np.arange(lines)
    starts = np.linspace(0, lines - SEGMENT, DOC_LINES // SEGMENT).astype(np.int64)
    return np.unique(starts[:, None] + np.arange(SEGMENT))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(2)]
        for a, b in _parts(texts):
            features, weights, per_text = line_features(texts[a:b])
            edges = np.concatenate([[0], np.cumsum(per_text)])
            rows = [(features[own].tobytes(), weights[own].tobytes()) for own in (s + _spaced(e - s) for s, e in zip(edges[:-1], edges[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["place", "label", "features", "weights"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents of the training folds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__label"))
    placed = known.select("__id", "__label", F.xxhash64("__id").alias("__place"))
    first = placed.orderBy("__place", "__id").limit(SAMPLE_DOCS).withColumn("__kind", F.lit(-1))
    for label in (0, 1):
        first = first.unionByName(placed.where(F.col("__label") == label).orderBy("__place", "__id").limit(SAMPLE_DOCS // 10).withColumn("__kind", F.lit(label)))
    drawn = sorted(first.collect(), key=lambda r: (-r["__kind"], r["__place"], r["__id"]))  # those of a kind come first
    taken: dict[int, tuple] = {}
    for r in drawn:
        if r["__kind"] >= 0 or len(taken) < SAMPLE_DOCS:
            taken.setdefault(r["__id"], (r["__id"], r["__label"], r["__place"]))
    kinds = [any(r["__kind"] == label for r in drawn) for label in (0, 1)]
    chosen = docs.sparkSession.createDataFrame(list(taken.values()), "__id long, __label int, __place long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text")).join(F.broadcast(chosen), "__id")
    # one row an id, that of the least text; written, as the budget counts lines before any features are made
    rows = materialise(rows.groupBy("__id", "__label", "__place").agg(F.min("__text").alias("__text")), "sample")
    breaks = F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit("")))
    fit_in, lines, spare = [], [0, 0], SAMPLE_LINES // 10
    for r in sorted(rows.select("__place", "__id", "__label", F.least(breaks + 1, F.lit(DOC_LINES)).alias("__lines")).collect()):
        if sum(lines) + r["__lines"] + max(0, spare - lines[1 - r["__label"]]) <= SAMPLE_LINES:
            fit_in.append((r["__id"],))
            lines[r["__label"]] += r["__lines"]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fit_in, "__id long")), "__id")
    found = rows.select("__place", "__label", F.encode("__text", "utf-8")).mapInArrow(_sample_features, "place long, label int, features binary, weights binary")
    samples = [(r["label"], np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["weights"], np.float64)) for r in found.orderBy("place", "features").toLocalIterator()]
    if all(kinds) and not all(lines):
        warnings.warn("there are labels of both kinds, but no sampled document of one: every document gets the same score", stacklevel=2)
    return train(samples)


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns, and those called `names`: the score, and 1 for scores of 0.5 or more."""
    kept = without(docs, names)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(at)]
            scores = np.ones(len(texts))
            for a, b in _parts(texts):
                scores[a:b] = model.score(qualities(model, *line_features(texts[a:b])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    names = private("score", "predicted")
    return score(docs, fit(docs, labels), names=tuple(names)).where(F.col(names[1]) == 1).drop(*names)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
