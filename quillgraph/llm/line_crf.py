"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad.  Its evidence is its own features and those
of the lines before and after it; a transition weight ties neighbouring labels.
Forward-backward gives each line's probability of being good, and the document's
score is their mean weighted by line length.  Trained on a bounded sample of
labelled documents, each line carrying its document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import Words, _byte_table, as_bytes, run_hashes, slices, spread

#: Labelled documents that the model is fitted on, at most, and the longest (bytes) among them.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 200_000
SAMPLE_LINES = 500_000

#: The score from which label 1 is predicted, and the held-out fold.
CUT = 0.3
FOLDS, HELD_OUT = 5, 0

STEPS, RATE, RIDGE = 250, 0.08, 1e-3

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "stop": [*b".,;:?'-"],
    "bang": [*b"!"], "bar": [*b"|"], "symbol": [*b"#*$%&<>@^~+=_\\/"], "high": [*range(128, 256)], "bracket": [*b"()[]{}\""],
}


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines per text (one at least), and line lengths.

    Lines are cut at newlines only.  Nothing but the text is looked at.
    """
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    text_ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(ends, text_ends) + 1]))
    owner = np.repeat(np.arange(len(parts)), counts)

    table = np.zeros(256, np.int64)
    found = {}
    for name, members in _CLASSES.items():
        table[:] = 0
        table[members] = 1
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        found[name] = (sums[ends] - sums[starts]).astype(np.float64)
    words = Words(parts)
    first = np.searchsorted(words.starts, np.append(starts, len(data)))
    n_words = np.diff(first).astype(np.float64)
    letters = found["upper"] + found["lower"] + found["high"]
    some = np.maximum(size, 1)

    # Share of the line's words that the line has more than once, and whether the text has the line twice.
    hashes = words.hashes(3)
    line_of = np.repeat(np.arange(len(starts)), n_words.astype(np.int64))
    order = np.lexsort((hashes, line_of))
    again = np.zeros(len(hashes), bool)
    if len(order) > 1:
        same = (hashes[order][1:] == hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
        again[order[1:][same]] = True
    repeats = np.bincount(line_of, weights=again, minlength=len(starts)) / np.maximum(n_words, 1)
    whole = run_hashes(_byte_table(5)[data], starts, ends, 5)
    order = np.lexsort((whole, owner))
    twin = np.zeros(len(whole), bool)
    if len(order) > 1:
        same = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twin[order[1:][same]] = twin[order[:-1][same]] = True
    per_word = lambda name: found[name] / np.maximum(n_words, 1)
    features = np.stack([
        np.log1p(size), np.log1p(n_words), found["upper"] / np.maximum(letters, 1), np.minimum(per_word("upper"), 3),
        found["digit"] / some, np.minimum(per_word("stop"), 2), np.minimum(per_word("bang"), 3), np.minimum(per_word("bar"), 2),
        np.minimum(per_word("symbol"), 4), np.minimum(letters / np.maximum(n_words, 1), 20) / 10, found["high"] / some,
        np.minimum(per_word("bracket"), 2), repeats, (twin & (size > 0)).astype(float), (size == 0).astype(float),
        (found["bang"] > 0).astype(float), (found["bar"] > 0).astype(float), (found["symbol"] > 0).astype(float),
        ((letters > 0) & (found["upper"] > 0.8 * letters)).astype(float),
    ], axis=1)
    return features, counts, size


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of a line beside those of the lines before and after it in its text, and marks for the ends."""
    starts = np.cumsum(counts) - counts
    lasts = starts + counts - 1
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[starts], after[lasts] = 0, 0
    ends = np.zeros((len(features), 2))
    ends[starts, 0] = ends[lasts, 1] = 1
    return np.concatenate([features, before, after, ends], axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray      # log-odds of good over bad, the last one the bias
    stay: float              # score of two neighbouring lines with equal labels

    def odds(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (with_neighbours(features, counts) - self.mean) / self.scale
        return x @ self.weights[:-1] + self.weights[-1]


def marginals(odds: np.ndarray, counts: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all texts together: P(good) of each line, P(equal to the line before), log Z of each text.

    Texts are taken longest first, so step t works on the texts that have a line t.
    Only the difference of the two states is carried.
    """
    order = np.argsort(-counts, kind="stable")
    starts, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    forward, backward = np.array(odds, dtype=np.float64), np.zeros(len(odds))
    log_z = np.zeros(len(sizes))
    pass_on = lambda d: np.logaddexp(d + stay, 0) - np.logaddexp(d, stay)   # difference after one transition
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        log_z[: active[t]] += np.logaddexp(forward[at - 1], stay)
        forward[at] += pass_on(forward[at - 1])
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        backward[at] = pass_on(backward[at + 1] + odds[at + 1])
    last = starts + sizes - 1
    log_z += np.logaddexp(forward[last], 0)
    good = 0.5 * (1 + np.tanh((forward + backward) / 2))
    equal = np.zeros(len(odds))
    inner = np.ones(len(odds), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    a, b = forward[at - 1], odds[at] + backward[at]
    same = np.logaddexp(a + b, 0) + stay
    equal[at] = 1 / (1 + np.exp(np.logaddexp(a, b) - same))
    return good, equal, log_z


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a small ridge, by Adam over the whole sample; the same every time."""
    x = with_neighbours(features, counts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    truth = np.repeat(labels, counts).astype(float)
    theta = np.zeros(x.shape[1] + 1)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    pairs = float((counts - 1).sum())
    per_text = 1 / np.maximum(len(counts), 1)
    for step in range(1, steps + 1):
        good, equal, _ = marginals(x @ theta[:-1], counts, theta[-1])
        grad = np.append(x.T @ (truth - good), pairs - equal.sum()) * per_text - RIDGE * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        theta = theta + RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, theta[:-1], float(theta[-1]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, seed: int = 3,
        most_lines: int = SAMPLE_LINES) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, the first by a seeded hash.

    Labels that are null or of unknown documents are left out; of several labels of one
    document the smallest counts, of several texts one.  Documents above ``most_bytes``
    are not learnt from, nor what lies beyond the first ``most_lines`` lines of all, so
    what reaches the driver is bounded.  Without any label every text scores one half.
    """
    labelled = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label")))
    body = F.coalesce("text", F.lit(""))
    usable = docs.select(
        "doc_id", "text", F.xxhash64(body).alias("_hash"),
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_lines"),
    ).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    first = (
        usable.select("doc_id", "_hash", "_lines").join(labelled, "doc_id").groupBy("doc_id", "_label")
        .agg(F.min(F.struct("_hash", "_lines")).alias("_t")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
        .select("doc_id", "_label", "_t.*")).collect()
    ends = np.cumsum([r["_lines"] for r in first])
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["_label"], r["_hash"]) for r, end in zip(first, ends) if end <= most_lines],
        "doc_id bigint, _label int, _hash bigint")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("text")):
                features, _, _ = line_features([text])
                out.append(features.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array(out, pa.binary())], names=["doc_id", "label", "features"])

    sample = usable.join(F.broadcast(chosen), ["doc_id", "_hash"]).groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    found = sample.mapInArrow(measured, "doc_id bigint, label int, features binary").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["features"]))
    width = line_features([b""])[0].shape[1]
    each = [np.frombuffer(r["features"], "<f4").reshape(-1, width).astype(float) for r in found]
    if not each:
        return Model(np.zeros(3 * width + 2), np.ones(3 * width + 2), np.zeros(3 * width + 3), 0.0)
    return train(np.concatenate(each), np.array([len(e) for e in each]), np.array([r["label"] for r in found]))


def label_lines(docs: DataFrame, model: Model, text: str = "text", into: str = "line_good") -> DataFrame:
    """Add the probability that each line is good, an array in the order of the lines.

    A null or empty text counts as one empty line.  A column called ``into`` is replaced.
    """
    @F.arrow_udf("array<double>")
    def good(texts: pa.Array) -> pa.Array:
        out, plain = [], as_bytes(texts)
        for cut in slices(plain):
            features, counts, _ = line_features(plain[cut])
            p, _, _ = marginals(model.odds(features, counts), counts, model.stay)
            out += np.split(p, np.cumsum(counts)[:-1])
        return pa.array(out, pa.list_(pa.float64()))

    return docs.withColumn(into, good(F.col(text)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the quality of every whole text: line probabilities weighted by line length (plus one).

    Null and empty texts get the score of one empty line.  Rows and other columns stay; a
    column called ``into`` is replaced.
    """
    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        out, plain = [np.empty(0)], as_bytes(texts)
        for cut in slices(plain):
            features, counts, size = line_features(plain[cut])
            p, _, _ = marginals(model.odds(features, counts), counts, model.stay)
            starts = np.cumsum(counts) - counts
            out.append(np.add.reduceat(p * (size + 1), starts) / np.add.reduceat(size + 1, starts))
        return pa.array(np.clip(np.concatenate(out), 0, 1))

    return spread(docs).withColumn(into, quality(F.col(text)))
