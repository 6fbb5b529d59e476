"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares two character strings by the subsequences of three symbols
they share; a subsequence counts ``DECAY ** span``, so gaps and inserted
characters weaken a match without ending it. Strings are mapped to kernel values
with landmark strings (Nyström), and a linear machine is fitted there. As every
kernel value is a sum over subsequences, the fitted machine is one weight per
subsequence, which is what the tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .arrays import NOT_SPACE, flat, kept_by_worker, mix, shingles, slices, span_hashes, words

# Documents of each class the machine is fitted on, at most.
SAMPLE = 4000
LANDMARKS = 256
DECAY = 0.6
# Log-likelihood ratio from which a string is taken to make documents toxic.
CHANCE = 25.0
# Strings taken where none reaches that.
RARE = 256
GAPPED = 300
# Symbols from the first to the last of a subsequence, at most.
REACH = 6
# Longer strings are compared in overlapping windows.
LONGEST = 24

# Symbols: a-z, the begin of a string, other letters in five classes.
_BEGIN, _OTHERS, _SYMBOLS = 26, 27, 32
_FEATURES = _SYMBOLS**3

_TRIPLES = [(0, j, k) for k in range(2, REACH) for j in range(1, k)]

# Distinct strings whose scores a worker remembers.
_REMEMBERED = 1 << 21


def _symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for every byte that begins a letter, 255 for the rest; and white space."""
    table = np.full(256, 255, np.uint8)
    table[97:123] = table[65:91] = np.arange(26)
    table[0xC2:0xF5] = _OTHERS
    symbol = table[data]
    high = np.flatnonzero(symbol == _OTHERS)
    after = np.append(data, np.uint8(0))[high + 1].astype(np.int64)
    latin = data[high] == 0xC3
    after = np.where(latin & (after < 0x9F) & (after != 0x97), after | 0x20, after)
    symbol[high] = _OTHERS + (after + data[high]) % (_SYMBOLS - _OTHERS)
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    return symbol, space[data]


def strings(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings to compare: symbols, and begin, end and row of each string.

    A string is the letters of one word, whatever signs stand between them; each
    run of four letters or more of a word that has signs inside; and four or more
    single letters in a row. Strings of fewer than three letters are left out.
    """
    symbol, space = _symbols(data)
    at = np.flatnonzero(symbol != 255)
    if not len(at):
        none = np.zeros(0, np.int64)
        return symbol[:0], none, none, none
    letters = symbol[at]
    # a letter begins a word after white space or a new row, a run after any sign
    word_no = np.cumsum(space)[at]
    row = np.searchsorted(bounds, at, "right") - 1
    ends_at = at + 1
    while True:  # bytes that go on a letter are not signs
        more = (ends_at < len(data)) & ((data[np.minimum(ends_at, len(data) - 1)] & 0xC0) == 0x80)
        if not more.any():
            break
        ends_at = ends_at + more
    new_word = np.append(True, (word_no[1:] != word_no[:-1]) | (row[1:] != row[:-1]))
    new_run = new_word | np.append(True, at[1:] != ends_at[:-1])
    word_begin = np.flatnonzero(new_word)
    word_end = np.append(word_begin[1:], len(at))
    run_begin = np.flatnonzero(new_run)
    run_end = np.append(run_begin[1:], len(at))
    runs_in_word = np.add.reduceat(new_run.astype(np.int64), word_begin)
    parted = runs_in_word[np.searchsorted(word_begin, run_begin, "right") - 1] > 1
    extra = parted & (run_end - run_begin >= 4)
    single = word_end - word_begin == 1
    edge = np.append(True, (single[1:] != single[:-1]) | (row[word_begin][1:] != row[word_begin][:-1]))
    chain_first = np.flatnonzero(edge)
    chain_last = np.append(chain_first[1:], len(single))
    spelled = single[chain_first] & (chain_last - chain_first >= 4)
    begin = np.concatenate([word_begin, run_begin[extra], word_begin[chain_first[spelled]]])
    end = np.concatenate([word_end, run_end[extra], word_end[chain_last[spelled] - 1]])
    # windows of long strings
    size = end - begin
    step = LONGEST // 2
    windows = np.where(size > LONGEST, -(-(size - LONGEST) // step) + 1, 1)
    first = np.repeat(begin, windows)
    shift = (np.arange(len(first)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
    begin = first + shift
    end = np.minimum(np.repeat(end, windows), begin + LONGEST)
    fit = end - begin >= 3
    return letters, begin[fit], end[fit], row[begin[fit]]


def subsequences(letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string its subsequences and their normalised weights, as two arrays.

    Equal subsequences of a string stand at one place with their weights summed;
    other places weigh nothing.
    """
    size = end - begin + 1
    wide = int(size.max()) + REACH
    held = np.full((len(begin), wide), 255, np.int64)
    held[:, 0] = _BEGIN
    for i in range(1, int(size.max())):
        there = size > i
        held[there, i] = letters[begin[there] + i - 1]
    keys = []
    for i in range(int(size.max())):
        for first, second, third in _TRIPLES:
            a, b, c = held[:, i + first], held[:, i + second], held[:, i + third]
            key = ((a * _SYMBOLS + b) * _SYMBOLS + c) * 8 + third
            keys.append(np.where((a == 255) | (b == 255) | (c == 255), _FEATURES * 8, key).astype(np.int32))
    key = np.sort(np.stack(keys, axis=1), axis=1)
    weight = np.array([DECAY**span for span in range(8)])[key & 7]
    feature = key >> 3
    weight[feature == _FEATURES] = 0
    # sum the weights of equal neighbours into the first of them
    new = np.ones(feature.shape, bool)
    new[:, 1:] = feature[:, 1:] != feature[:, :-1]
    starts = np.flatnonzero(new.reshape(-1))
    sums = np.zeros(feature.size)
    sums[starts] = np.add.reduceat(weight.reshape(-1), starts)
    sums = sums.reshape(feature.shape)
    norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    return np.minimum(feature, _FEATURES - 1), sums / np.maximum(norm, 1e-12)


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = np.frombuffer("".join(words).encode("ascii"), np.uint8) - 64
    ends = np.cumsum([len(w) for w in words])
    return joined, np.append(0, ends[:-1]).astype(np.int64), ends.astype(np.int64)


def _in_parts(words: list[str], size: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first in range(0, len(words), size):
        yield subsequences(*_encode(words[first : first + size]))


class Machine:
    """A weight per subsequence, and the line that turns a document's values into a probability."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset, self.line = weights, offset, np.zeros(4)

    def values(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin))
        for first in range(0, len(begin), 4000):
            part = slice(first, first + 4000)
            feature, weight = subsequences(letters, begin[part], end[part])
            out[part] = (self.weights[feature] * weight).sum(axis=1) + self.offset
        return out


# What a document's values are when it has too few strings: two margins on the clean side.
_NOTHING = -2.0

# The values of a document: its two highest ones, and the logarithm of all above -0.5.
VALUES = ["__best", "__second", "__total"]


def fit_machine(
    toxic: list[str],
    clean: list[str],
    weights: np.ndarray,
    margins: np.ndarray,
    landmarks: int = LANDMARKS,
) -> Machine:
    """Squared-hinge machine on the landmark map, as weights of subsequences.

    Half of the landmarks are toxic strings and half clean ones, the first of
    each list. ``weights`` and ``margins`` have one number per string, toxic ones
    first: what a string counts, and how far from the border it should lie.
    """
    chosen = toxic[: landmarks // 2] + clean[: landmarks - min(len(toxic), landmarks // 2)]
    marks = np.zeros((len(chosen), _FEATURES), np.float32)
    for feature, weight in _in_parts(chosen, len(chosen)):
        for i in range(len(chosen)):
            np.add.at(marks[i], feature[i], weight[i])
    kernel = marks @ marks.T
    value, vector = np.linalg.eigh(kernel.astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    columns = np.ascontiguousarray(marks.T)
    rows = []
    for feature, weight in _in_parts(toxic + clean, 256):
        rows.append(np.einsum("nf,nfl->nl", weight.astype(np.float32), columns[feature]))
    mapped = np.hstack([np.vstack(rows) @ root, np.ones((len(toxic) + len(clean), 1))])
    y = np.append(np.ones(len(toxic)), -np.ones(len(clean)))
    cost = weights.astype(np.float64).copy()
    cost[y > 0] *= 0.5 / cost[y > 0].sum()
    cost[y < 0] *= 0.5 / cost[y < 0].sum()
    w = np.zeros(mapped.shape[1])
    ridge = np.full(len(w), 1e-5)
    ridge[-1] = 1e-8
    for _ in range(30):
        active = y * (mapped @ w) < margins
        x, c = mapped[active], cost[active]
        new = np.linalg.solve((x * c[:, None]).T @ x + np.diag(ridge), x.T @ (c * (y * margins)[active]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return Machine((marks.T @ (root @ w[:-1])).astype(np.float64), float(w[-1]))


def document_values(docs: DataFrame, machine: Machine, keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``__best, __second, __total``, without ``text`` unless it is to be kept.

    The highest and second highest value of the document's strings, and the
    logarithm of what all of them have above -0.5 together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    label = f"toxicity-{mix(machine.weights.view(np.uint64)).sum():x}"
    others = [c for c in docs.columns if keep_text or c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept_by_worker(label, lambda: {"hash": np.zeros(0, np.uint64), "value": np.zeros(0)})
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat(part.column("text"))
                letters, begin, end, row = strings(data, bounds)
                hashes, first, which = np.unique(
                    span_hashes(letters, begin, end), return_index=True, return_inverse=True
                )
                at = np.searchsorted(memory["hash"], hashes)
                new = np.ones(len(hashes), bool)
                inside = at < len(memory["hash"])
                new[inside] = memory["hash"][at[inside]] != hashes[inside]
                values = np.zeros(len(hashes))
                values[~new] = memory["value"][at[~new]]
                values[new] = sent.value.values(letters, begin[first[new]], end[first[new]])
                if len(memory["hash"]) > _REMEMBERED:
                    memory["hash"], memory["value"], at = np.zeros(0, np.uint64), np.zeros(0), at * 0
                memory["hash"] = np.insert(memory["hash"], at[new], hashes[new])
                memory["value"] = np.insert(memory["value"], at[new], values[new])
                value = values[which]
                n = part.num_rows
                best, second, total = np.full(n, _NOTHING), np.full(n, _NOTHING), np.zeros(n)
                np.add.at(total, row, np.maximum(value + 0.5, 0))
                order = np.lexsort((value, row))
                row, held = row[order], value[order]
                last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
                best[row[last]] = np.maximum(held[last], _NOTHING)
                two = last[(last > 0) & (row[last - 1] == row[last])]
                second[row[two]] = np.maximum(held[two - 1], _NOTHING)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others]
                    + [pa.array(best), pa.array(second), pa.array(np.log1p(total))],
                    names=[*others, *VALUES],
                )

    rows = docs.select(*[F.col(f"`{c}`") for c in [*others, *([] if keep_text else ["text"])]])
    schema = T.StructType([f for f in rows.schema if f.name in others])
    for name in VALUES:
        schema = schema.add(name, "double")
    return rows.mapInArrow(score, schema)


def document_strings(docs: DataFrame) -> DataFrame:
    """``doc, toxic, word``: the distinct strings of every document, as letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat(part.column("text"))
                letters, begin, end, row = strings(data, bounds)
                text = (letters + 64).tobytes().decode("ascii")
                pairs = sorted({(r, text[a:b]) for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist())})
                rows = pa.array([r for r, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc").take(rows),
                        part.column("toxic").take(rows),
                        pa.array([w for _, w in pairs], pa.string()),
                    ],
                    names=["doc", "toxic", "word"],
                )

    return docs.select("doc", "toxic", "text").mapInArrow(cut, "doc long, toxic int, word string")


def _distinct_documents(docs: DataFrame, draws: int = 3) -> DataFrame:
    """``doc, toxic, text`` without near copies.

    A document goes if one with a smaller number shares any of its ``draws``
    lowest shingle hashes; copies would make all their words look telling.
    """
    factors = mix(np.arange(11, 11 + draws, dtype=np.uint64)) | np.uint64(1)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat(part.column("text"))
                starts, ends, cuts = words(data, bounds, NOT_SPACE)
                found, cuts = shingles(span_hashes(data, starts, ends), cuts, 5)
                filled = np.flatnonzero(cuts[1:] > cuts[:-1])
                for factor in factors if len(filled) else []:
                    low = np.minimum.reduceat(found * factor, cuts[:-1][filled])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc").take(pa.array(filled)), pa.array((low ^ factor).view(np.int64))],
                        names=["doc", "low"],
                    )

    lows = docs.select("doc", "text").mapInArrow(lowest, "doc long, low long")
    copies = lows.join(lows.groupBy("low").agg(F.min("doc").alias("first")), "low").where("doc > first")
    return docs.join(copies.select("doc").distinct(), "doc", "left_anti")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on labelled documents.

    None without both classes, or if no string stands in toxic documents more
    often than in clean ones. Where no string is telling enough by itself, the
    ``RARE`` ones with the highest ratio are taken.

    At most ``sample`` documents of each class, taken in the order of a hash and
    rid of copies, are cut into strings. Which string makes a toxic document
    toxic is not labelled: those are taken that stand in more toxic and fewer
    clean documents than chance allows (log-likelihood ratio of ``CHANCE``). They
    are set against strings of clean sentences, first frequent and arbitrary
    ones. Then, twice, strings that the machine finds alike and that clean
    documents hardly have join the first, and those of clean documents that it
    scores highest the second. A string should lie the further from the border
    the more it tells; the ``GAPPED`` most telling ones are also learned with a
    letter inserted.
    """
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rated = rated.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    picked = None
    for label in (0, 1):
        part = rated.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    picked = stored(picked, "toxicity-sample")
    # at most 2 * sample rows of two numbers
    known = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    known = known.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("doc"), "toxic", "text")
    known = stored(known.dropDuplicates(["doc"]), "toxicity-all")
    known = stored(_distinct_documents(known), "toxicity-texts")
    counts = document_strings(known).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    counts = stored(counts, "toxicity-counts")
    n_toxic, n_clean = (known.where(F.col("toxic") == label).count() for label in (1, 0))
    if not n_toxic or not n_clean:
        return None
    rate = F.col("good") * n_toxic / n_clean
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("bad") + F.col("good")
    part = lambda n, of: F.when(n > 0, n * F.log(n / (both * of))).otherwise(0)
    ratio = 2 * (part(F.col("bad"), share) + part(F.col("good"), 1 - share))
    odds = F.log((F.col("bad") + 0.5) / (rate + 0.5))
    telling = counts.where((rate < 0.05 * F.col("bad")) & (ratio >= CHANCE)).orderBy(F.desc(ratio), "word")
    telling = telling.limit(sample).select("word", "bad", odds.alias("odds")).collect()
    if not telling:
        # insults that are each too rare for the ratio: the strings with the highest one
        rare = counts.where(F.col("bad") > rate).orderBy(F.desc(ratio), F.desc(odds), "word").limit(RARE)
        telling = rare.select("word", "bad", odds.alias("odds")).collect()
    if not telling:
        return None
    bad = {row.word: row.bad for row in telling}
    strength = {row.word: row.odds for row in telling}
    plain = counts.where(F.col("good") > 0)
    common = plain.orderBy(F.desc("good"), "word").limit(sample).collect()
    other = plain.orderBy(F.xxhash64("word"), "word").limit(sample).collect()
    clean = {row.word: row.good for row in [*common, *other] if row.word not in bad}

    gapped = {
        word[:at] + letter + word[at:]: word
        for word in list(bad)[:GAPPED]
        if len(word) >= 5
        for at, letter in ((2, "X"), (len(word) // 2, "S"), (len(word) - 2, "F"))
    }

    def fitted() -> Machine:
        written = [w for w in gapped if w not in bad and w not in clean]
        weights = [*bad.values(), *(bad[gapped[w]] / 4 for w in written), *clean.values()]
        margins = [strength[w] / 2 for w in bad] + [strength[gapped[w]] / 3 for w in written]
        return fit_machine(
            [*bad, *written],
            list(clean),
            np.sqrt(np.array(weights, float)),
            np.append(np.clip(margins, 0.5, 3), np.ones(len(clean))),
        )

    machine = fitted()
    for _ in range(2):
        # relabel: strings like the chosen ones that clean documents hardly have
        suspect = (F.col("bad") >= 2) & (rate < 0.2 * F.col("bad"))
        alike = _highest(counts.where(suspect), machine, sample // 4)
        for row in alike:
            if row.value > 0 and row.word not in bad:
                bad[row.word] = row.bad
                strength[row.word] = np.log((row.bad + 0.5) / (row.good * n_toxic / n_clean + 0.5))
        hard = _highest(plain.where(~suspect), machine, sample // 4)
        clean.update({row.word: row.good for row in hard})
        clean = {word: n for word, n in clean.items() if word not in bad}
        machine = fitted()
    seen = document_values(known.select("toxic", "text"), machine).toPandas()
    machine.line = _logistic(seen[VALUES].to_numpy(), seen["toxic"].to_numpy())
    return machine


def _highest(counts: DataFrame, machine: Machine, n: int) -> list:
    """The ``n`` strings of ``counts`` that the machine scores highest."""
    sent = counts.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = sent.value.values(*_encode(batch.column("word").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("word", "bad", "good")] + [pa.array(value)],
                    names=["word", "bad", "good", "value"],
                )

    scored = counts.select("word", "bad", "good").mapInArrow(
        score, "word string, bad long, good long, value double"
    )
    return scored.orderBy(F.desc("value"), "word").limit(n).collect()


def _logistic(values: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The line through documents' values and labels, its shift last."""
    bad, good = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.hstack([values, np.ones((len(values), 1))])
    line = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        free = np.append(~((line[:-1] <= 0) & ((x.T @ (p - target))[:-1] > 0)), True)
        slope = (x.T @ (p - target) + 1e-2 * line)[free]
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(bend[np.ix_(free, free)], slope)
        line[free] -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        line[:-1] = np.maximum(line[:-1], 0)  # no value speaks for a clean text
        if np.abs(step).max() < 1e-6:
            break
    return line


def toxicity(docs: DataFrame, machine: Machine | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` without ``text`` plus ``score`` (0 to 1) and ``predicted`` (0 or 1).

    A document is as toxic as its worst strings, see ``document_values``. Texts
    without strings (null, empty, signs only) score as if these lay two margins
    on the clean side. Without a machine all scores are 0. Repeated rows get
    equal scores; an empty table gives no rows; other columns pass through
    whatever their names are, but ``score`` and ``predicted`` are replaced.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "score", "predicted")]
    if machine is None:
        scored = docs.select(*others, F.lit(0.0).alias("score"))
    else:
        values = document_values(docs.select(*others, "text"), machine)
        scored = values.withColumn("score", _probability(machine)).drop(*VALUES)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _probability(machine: Machine) -> Column:
    line = sum((F.col(c) * float(k) for c, k in zip(VALUES, machine.line)), F.lit(float(machine.line[-1])))
    return 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))


def not_toxic(docs: DataFrame, machine: Machine | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are."""
    if machine is None:
        return docs
    values = document_values(docs, machine, keep_text=True)
    return values.where(_probability(machine) < threshold).drop(*VALUES)


def fold(doc_id: Column, parts: int) -> Column:
    """The crc32 of the id as text, modulo ``parts``; a null id is empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts
