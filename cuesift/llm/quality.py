"""Quality by positive-unlabelled learning on measures of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .arrays import LOWER, NOT_SPACE, flat, slices, span_hashes, words


# Trusted documents the classifier is fitted on, at most.
TRUSTED = 8000

# Documents that show how the risk bends, at most. They choose the steps towards
# its minimum; the risk and its slope are summed over all documents.
CURVATURE = 16000

# A measure is counted in so many cells, which are gathered into bins.
CELLS = 4096
BINS = 14

MEASURES = [
    "bytes", "spaces", "upper", "digits", "signs", "marks", "high",
    "words", "word_bytes", "long_words", "bare", "signed", "shouted", "again", "distinct", "commonest",
    "lines", "line_words", "distinct_lines", "stops",
]

# All others are shares.
SIZES = [MEASURES.index(name) for name in ("bytes", "words", "word_bytes", "lines", "line_words")]


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` for every text of about a megabyte; an empty text has zeros."""
    data, bounds = flat(column)
    n = len(column)
    out = np.zeros((n, len(MEASURES)))
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    letter = np.zeros(256, bool)
    upper = np.zeros(256, bool)
    upper[65:91] = True
    letter[65:91] = letter[97:123] = letter[0x80:] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    sign = ~(letter | digit) & NOT_SPACE
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in "#$%&*|!<>{}[]=+^~_\\@/"]] = True
    letters = np.maximum(per_row(letter[data]), 1)
    out[:, 0] = np.log1p(size)
    out[:, 1] = per_row(~NOT_SPACE[data]) / some
    out[:, 2] = per_row(upper[data]) / letters
    out[:, 3] = per_row(digit[data]) / some
    out[:, 4] = per_row(sign[data]) / some
    out[:, 5] = per_row(mark[data]) / some
    out[:, 6] = per_row(data >= 0x80) / some
    begin, end, cuts = words(data, bounds, NOT_SPACE)
    count = np.diff(cuts).astype(float)
    have = np.maximum(count, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.float64))
        return total[cuts[1:]] - total[cuts[:-1]]

    if len(begin):
        inside = lambda flags: np.diff(np.append(0, np.cumsum(flags))[np.stack([begin, end])], axis=0)[0]
        length, n_letters, n_upper = end - begin, inside(letter[data]), inside(upper[data])
        row = np.repeat(np.arange(n), np.diff(cuts))
        hashes = span_hashes(LOWER[data], begin, end)
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
        order = np.lexsort((hashes, row))
        kind_row, kind = row[order], hashes[order]
        first = np.append(True, (kind[1:] != kind[:-1]) | (kind_row[1:] != kind_row[:-1]))
        starts = np.flatnonzero(first)
        runs = np.diff(np.append(starts, len(kind)))
        commonest = np.zeros(n)
        np.maximum.at(commonest, kind_row[starts], runs)
        out[:, 8] = np.log1p(per_word(length) / have)
        out[:, 9] = per_word(length > 24) / have
        out[:, 10] = per_word(n_letters == 0) / have
        out[:, 11] = per_word(mark[data[end - 1]] | mark[data[begin]]) / have
        out[:, 12] = per_word((n_upper == n_letters) & (n_letters >= 2)) / have
        out[:, 13] = per_word(same) / have
        out[:, 14] = np.bincount(kind_row[starts], minlength=n) / have
        out[:, 15] = commonest / have
    out[:, 7] = np.log1p(count)
    line = np.ones(256, bool)
    line[[10, 13]] = False
    begin, end, cuts = words(data, bounds, line)
    count = np.diff(cuts).astype(float)
    lines = np.maximum(count, 1)
    if len(begin):
        row = np.repeat(np.arange(n), np.diff(cuts))
        pair = np.unique(np.stack([row.astype(np.uint64), span_hashes(data, begin, end)]), axis=1)[0]
        out[:, 18] = np.bincount(pair.astype(np.int64), minlength=n) / lines
        out[:, 19] = per_word(np.isin(data[end - 1], [ord(c) for c in ".!?"])) / lines
    out[:, 16] = np.log1p(count)
    out[:, 17] = np.log1p(np.expm1(out[:, 7]) / lines)
    return out


def cells(values: np.ndarray) -> np.ndarray:
    """Measures as whole numbers below ``CELLS``, in the same order and finer towards zero."""
    out = np.sqrt(values) * (CELLS - 1)
    # logarithms of sizes, the largest of which is below 22
    out[:, SIZES] = values[:, SIZES] * ((CELLS - 1) / 22)
    return np.clip(out, 0, CELLS - 1).astype("<u2")


class Classifier:
    """A weight for each bin of each measure."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, offset: float, prior: float) -> None:
        self.edges, self.weights, self.offset, self.prior = edges, weights, offset, prior

    def bins(self, rows: np.ndarray) -> np.ndarray:
        """The place of each measure's bin among all bins, for rows of ``cells``."""
        which = [np.searchsorted(e, v, "right") for e, v in zip(self.edges, rows.T)]
        return np.stack(which, axis=1) + np.arange(rows.shape[1]) * BINS

    def odds(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(rows)].sum(axis=1) + self.offset


class Everything:
    """The cells of all documents: a written table, read once for every sum over it."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def total(self, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``of``, which makes ``size`` numbers of a batch of rows."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    sums += of(_joined(batch.column("cells").to_pylist()))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "part"])

        parts = self.table.select("cells").mapInArrow(add, "at long, part double")
        out = np.zeros(size)
        # at most ``size`` rows, whatever the number of documents
        for row in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():
            out[row["at"]] = row["part"]
        return out


def _joined(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, len(MEASURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cell_counts(rows: np.ndarray) -> np.ndarray:
    places = rows.astype(np.int64) + np.arange(rows.shape[1]) * CELLS
    return np.bincount(places.reshape(-1), minlength=rows.shape[1] * CELLS)


def bin_edges(counts: np.ndarray) -> np.ndarray:
    """``BINS - 1`` edges of each measure from the counts of its cells.

    Twelfths of all documents, their last hundredth, and what is above the least
    value. Equal edges leave bins empty.
    """
    levels = np.append(np.linspace(0, 1, BINS - 1)[1:-1], 0.99)
    edges = []
    for row in counts:
        until = np.cumsum(row)
        above_least = np.flatnonzero(row)[0] + 1
        edges.append(np.sort(np.append(np.searchsorted(until, levels * until[-1]), above_least)))
    return np.stack(edges)


def _thresholds(trusted: np.ndarray) -> np.ndarray:
    # equal scores count as reached, however their sums were rounded
    return np.quantile(trusted, np.linspace(0, 0.8, 81)) - 1e-9


def _least_quotient(trusted: np.ndarray, of_all: np.ndarray, count: int) -> float:
    of_trusted = (trusted[:, None] >= _thresholds(trusted)).mean(axis=0)
    slack = np.sqrt(of_all * (1 - of_all) / count) + np.sqrt(of_trusted * (1 - of_trusted) / len(trusted))
    return float(np.clip(((of_all + slack) / of_trusted).min(), 0.01, 0.99))


def estimated_prior(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled ones, from scores that tell the two sets apart.

    Where scores are high, the unlabelled set holds hardly anything but good
    texts, so its share of texts above a threshold, divided by that of the
    trusted set, comes down to the prior. The least quotient is taken, each with
    the error that its counts allow.
    """
    above = (unlabelled[:, None] >= _thresholds(trusted)).mean(axis=0)
    return _least_quotient(trusted, above, len(unlabelled))


def _as_negatives(bins: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The loss of texts as negatives, summed: its slope by every weight, by the offset, and itself."""
    odds = w[bins].sum(axis=1) + w[-1]
    by = _sigmoid(odds)
    held = np.bincount(bins.reshape(-1), np.repeat(by, bins.shape[1]), minlength=len(w) - 1)
    return np.concatenate([held, [by.sum(), np.logaddexp(0, odds).sum()]])


def _design(bins: np.ndarray, size: int) -> np.ndarray:
    held = np.zeros((len(bins), size))
    held[np.arange(len(bins))[:, None], bins] = 1
    held[:, -1] = 1
    return held


def least_risk(
    good: np.ndarray,
    curved: np.ndarray,
    losses: Callable[[np.ndarray], np.ndarray],
    shares: tuple[float, float, float],
    w: np.ndarray,
    ridge: float,
    steps: int = 30,
) -> np.ndarray:
    """Weights of low non-negative risk, from ``w`` on: the least, or where a step cannot go on above zero.

    ``shares`` weigh the loss of the trusted texts as positives, that of all
    texts as negatives, and that of the trusted texts as negatives, which is
    taken off the second. What is left of it cannot truly be below zero, so steps
    that would make it so are halved, as are steps that do not lower the risk.
    ``losses`` gives the mean of ``_as_negatives`` over all texts; ``curved`` are
    the texts that stand for all in the second derivative.
    """
    as_positive, of_all, taken_off = shares
    keep = np.append(np.full(len(w) - 1, ridge), 0)
    held_good, held_curved = _design(good, len(w)), _design(curved, len(w))

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray]:
        odds, every = held_good @ w, of_all * losses(w)
        by = _sigmoid(odds)
        negative = every[-1] - taken_off * np.logaddexp(0, odds).mean()
        slope = every[:-1] + held_good.T @ (as_positive * (by - 1) - taken_off * by) / len(good) + keep * w
        risk = as_positive * np.logaddexp(0, -odds).mean() + max(negative, 0) + (keep * w * w).sum() / 2
        return risk, negative, slope

    def bend(w: np.ndarray) -> np.ndarray:
        out = np.diag(keep + 1e-9)
        for held, share in ((held_good, as_positive - taken_off), (held_curved, of_all)):
            by = _sigmoid(held @ w)
            out = out + held.T @ (held * (share * by * (1 - by) / len(held))[:, None])
        return out

    risk, negative, slope = at(w)
    while negative < 0:
        w = w / 2
        risk, negative, slope = at(w)
    for _ in range(steps):
        step = np.linalg.solve(bend(w), slope)
        gain = slope @ step
        if gain < 1e-7:
            break
        for halved in 0.5 ** np.arange(6):
            tried = w - halved * step
            found = at(tried)
            if found[1] >= 0 and found[0] <= risk - 1e-4 * halved * gain:
                break
        else:
            break
        w, (risk, negative, slope) = tried, found
    return w


def fit(trusted: np.ndarray, curved: np.ndarray, everything: Everything, ridge: float = 3e-4) -> Classifier:
    """Classifier of least non-negative risk over ``everything``.

    With prior p, the risk of a positive is p times the loss of the trusted
    texts as positives, and the risk of a negative is the loss of all texts as
    negatives less p times that of the trusted ones. The bin edges, the prior and
    both risks come from sums over all documents; each minimum is looked for
    among the ``curved`` ones first, so that few sums remain.
    """
    counts = everything.total(len(MEASURES) * CELLS, _cell_counts).reshape(len(MEASURES), CELLS)
    count = int(counts[0].sum())
    model = Classifier(bin_edges(counts), np.zeros(len(MEASURES) * BINS), 0.0, 0.5)
    size = len(model.weights)
    good, some = model.bins(trusted), model.bins(curved)

    def over_some(w: np.ndarray) -> np.ndarray:
        return _as_negatives(some, w) / len(some)

    def over_all(w: np.ndarray) -> np.ndarray:
        return everything.total(size + 2, lambda rows: _as_negatives(model.bins(rows), w)) / count

    def least(shares: tuple[float, float, float]) -> Classifier:
        w = np.zeros(size + 1)
        for losses in (over_some, over_all):
            w = least_risk(good, some, losses, shares, w, ridge)
        return Classifier(model.edges, w[:size], float(w[size]), shares[0])

    apart = least((0.5, 0.5, 0.0))
    of_trusted = apart.odds(trusted)
    levels = _thresholds(of_trusted)
    above = everything.total(len(levels), lambda rows: (apart.odds(rows)[:, None] >= levels).sum(axis=0))
    prior = _least_quotient(of_trusted, above / count, count)
    return least((prior, 1.0, prior))


def document_cells(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``cells`` of its measures, two bytes each, of every document."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [row.tobytes() for row in cells(measures(part.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "cells"]
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(take, T.StructType([rows.schema["doc_id"]]).add("cells", "binary"))


def train(
    docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, curvature: int = CURVATURE
) -> Classifier | None:
    """A classifier from trusted good documents and all documents, without a label.

    ``labels(doc_id, quality)``: only rows with quality 1 are used, as trusted
    positives; zeros are never looked at. At most ``trusted`` of them are taken in
    the order of a hash. Bin edges, prior and risk come from every document, one
    row of each id and every row without one; ``curvature`` of them are sent to
    the driver for the second derivative alone. Without a positive or without
    documents there is no classifier.
    """
    measured = document_cells(docs)
    known = measured.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("cells").alias("cells"))
    table = stored(known.unionByName(measured.where(F.col("doc_id").isNull())), "quality-cells")
    order = F.xxhash64("doc_id", F.lit(29))
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = stored(good.orderBy(order, "doc_id").limit(trusted), "quality-trusted")
    # at most ``trusted`` rows of one value
    positives = table.join(F.broadcast(good), "doc_id", "left_semi").select("cells")
    sample = table.orderBy(order, "doc_id", "cells").limit(curvature).select("cells")
    chosen, curved = (_joined([r["cells"] for r in part.collect()]) for part in (positives, sample))
    if not len(chosen) or not len(curved):
        return None
    return fit(chosen, curved, Everything(table))


def quality(docs: DataFrame, classifier: Classifier | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` without ``text`` plus ``score`` (0 to 1) and ``predicted`` (0 or 1).

    The score is the probability that the text is good. Null and empty texts are
    measured as zeros and scored like any other; without a classifier all scores
    are 0.5. Repeated rows get equal scores, an empty table gives no rows. Other
    columns pass through, but ``score`` and ``predicted`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], "text")
    if classifier is None:
        scored = rows.drop("text").withColumn("score", F.lit(0.5))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(classifier)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    values = _sigmoid(sent.value.odds(cells(measures(part.column("text")))))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in others] + [pa.array(values)], names=[*others, "score"]
                    )

        schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("score", "double")
        scored = rows.mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
