"""Which texts contain which terms, without comparing every pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import GRAM_LENGTH
from ..session import salted_join
from .terms import LITERAL_TERMS, Terms

# Characters searched at once inside a task.
_SLICE = 1 << 20
# Bits of a character, and what stands between two texts.
_CHAR, _BREAK = 21, (1 << 21) - 1


def grams(folded: Column, size: int) -> Column:
    """Every run of ``size`` code points, in order of position."""
    return F.regexp_extract_all(folded, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1))


def match_terms(
    texts: DataFrame,
    text: str,
    key: str,
    terms: Terms,
    fold: Callable[[Column], Column],
    literal_limit: int = LITERAL_TERMS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``texts`` paired with each distinct ``folded`` term they contain.

    Few terms become literal substring tests in the scan. More terms are sent to
    the tasks and found by their character runs where the texts are read. Terms
    too many for that meet the texts by equality: each text offers its short
    runs, each term asks for one of them, and the pairs that meet are verified
    on the whole text. ``key`` identifies a text, ``keep`` names the columns to
    return (all of them by default).
    """
    kept = texts.columns if keep is None else keep
    literals = terms.literals(literal_limit)
    if literals is not None:
        found = _match_literals(texts, text, literals, fold)
    elif terms.few:
        found = count_terms(texts, text, terms, fold, kept)
    else:
        found = _match_grams(texts, text, key, terms, fold)
    return found.select(*kept, "folded")


def count_terms(
    texts: DataFrame, text: str, terms: Terms, fold: Callable[[Column], Column], keep: list[str]
) -> DataFrame:
    """``keep``, ``folded``, ``tf``: how often each of few terms stands in each text, overlaps too.

    Nothing is shuffled and no text leaves its task.
    """
    folded = sorted({row.folded for row in terms.rows if row.folded})
    rows = texts.select(*keep, fold(F.col(text)).alias("__low"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "folded string", "tf long"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, names = _Lookup(folded), pa.array(folded, pa.string())
        for batch in batches:
            lows = batch.column("__low").fill_null("")
            sizes = pc.utf8_length(lows).to_numpy().astype(np.int64)
            part = np.cumsum(sizes + 1) // _SLICE
            ends = [*(np.flatnonzero(np.diff(part)) + 1), len(lows)]
            for begin, end in zip([0, *ends], ends):
                term, row, tf = lookup.occurrences(lows[begin:end], sizes[begin:end])
                at = pa.array(row + begin)
                columns = [batch.column(c).take(at) for c in keep]
                columns += [names.take(pa.array(term)), pa.array(tf)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "folded", "tf"])

    return rows.mapInArrow(find, schema)


def _code(run: np.ndarray, size: int) -> np.ndarray:
    """Runs of ``size`` characters as numbers, one for each place of ``run``."""
    code = run[: len(run) - GRAM_LENGTH + 1].copy()
    for at in range(1, size):
        code = (code << _CHAR) | run[at : at + len(code)]
    return code


class _Lookup:
    """Terms by the runs of up to three characters that spell them."""

    def __init__(self, folded: list[str]):
        self.covers, runs = [], {}
        for term in folded:
            size = min(len(term), GRAM_LENGTH)
            offsets = sorted({*range(0, len(term) - size + 1, size), len(term) - size})
            chars = np.frombuffer(term.encode("utf-32-le"), "<u4").astype(np.int64)
            codes = [int(reduce(lambda a, c: (a << _CHAR) | int(c), chars[o : o + size], 0)) for o in offsets]
            self.covers.append((size, list(zip(codes, offsets, strict=True))))
            runs.setdefault(size, set()).update(codes)
        self.wanted = {size: np.array(sorted(codes), np.int64) for size, codes in runs.items()}
        number = {size: {int(c): i for i, c in enumerate(codes)} for size, codes in self.wanted.items()}
        self.covers = [(size, [(number[size][c], o) for c, o in cover]) for size, cover in self.covers]

    def occurrences(self, lows: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, text and count of every pair that meets, by term and text."""
        gap = chr(0) * GRAM_LENGTH
        run = np.frombuffer((chr(0).join(lows.to_pylist()) + gap).encode("utf-32-le"), "<u4").astype(np.int64)
        after = np.cumsum(sizes + 1) - 1
        run[after] = run[-GRAM_LENGTH:] = _BREAK
        spelled, spots = {}, {}
        for size, wanted in self.wanted.items():
            code = _code(run, size)
            near = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            at = np.flatnonzero(wanted[near] == code)
            which = near[at].astype(np.uint16 if len(wanted) < 1 << 16 else np.int64)
            order = np.argsort(which, kind="stable")
            # the run that stands at each place, and the places of each run
            spelled[size] = np.full(len(run), -1, np.int64)
            spelled[size][at] = which
            spots[size] = at[order], np.searchsorted(which[order], np.arange(len(wanted) + 1))
        found = []
        for term, (size, cover) in enumerate(self.covers):
            places, ends = spots[size]
            rarest, offset = min(cover, key=lambda c: ends[c[0] + 1] - ends[c[0]])
            starts = places[ends[rarest] : ends[rarest + 1]] - offset
            starts = starts[starts >= 0]
            for code, offset in cover:
                if not len(starts):
                    break
                if code != rarest or len(cover) > 1:
                    starts = starts[spelled[size][np.minimum(starts + offset, len(run) - 1)] == code]
            if len(starts):
                found.append((term, starts))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.searchsorted(after, np.concatenate([starts for _, starts in found]))
        term = np.repeat([t for t, _ in found], [len(starts) for _, starts in found])
        first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(text) != 0)))
        return term[first], text[first], np.diff(np.append(first, len(text)))


def _match_literals(
    texts: DataFrame, text: str, literals: list[str], fold: Callable[[Column], Column]
) -> DataFrame:
    if not literals:
        return texts.where(F.lit(False)).withColumn("folded", F.lit(None).cast("string"))
    tests = [F.contains(fold(F.col(text)), F.lit(value)) for value in literals]
    found = F.array_compact(
        F.array(*[F.when(test, F.lit(value)) for test, value in zip(tests, literals, strict=True)])
    )
    return texts.where(reduce(or_, tests)).withColumn("folded", F.explode(found))


def _match_grams(
    texts: DataFrame, text: str, key: str, terms: Terms, fold: Callable[[Column], Column]
) -> DataFrame:
    probes = terms.distinct().withColumn(
        "__gram",
        F.when(F.length("folded") <= GRAM_LENGTH, F.col("folded")).otherwise(
            F.substring("folded", 1, GRAM_LENGTH)
        ),
    )
    # at most three values: the lengths of the runs to offer
    sizes = sorted(r[0] for r in probes.select(F.length("__gram")).distinct().collect())
    offered = F.array_distinct(F.concat(*[grams(fold(F.col(text)), size) for size in sizes]))
    pairs = salted_join(
        texts.select(key, F.explode(offered).alias("__gram")),
        probes,
        ["__gram"],
        "inner",
        F.col(key),
    )
    met = texts.join(pairs, key)
    return met.where(F.contains(fold(F.col(text)), F.col("folded"))).drop("__gram")
