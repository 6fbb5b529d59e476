"""Personal data by fixed forms, and by contexts learned from what these find."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrays import slices

# The kinds in their order, and their forms.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# What a learned identifier of each kind has to look like: shorter of the
# digits or other parts than the fixed form asks for, or with other signs.
LOOKS = {
    "email": r"[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9.-]+",
    "ip": r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}",
    "card": r"[0-9]{4}(?:[./_][0-9]{4}){2,4}",
    "phone": r"[(]?[0-9]{2,4}[)./-]?[0-9]{2,4}(?:[./-][0-9]{2,5}){1,3}",
}

# Words before an identifier that make up its context, and the characters at
# the end of each that count.
CONTEXT = 2
TAIL = 40
# Change of a pattern's score below which all scores count as final.
SETTLED = 1e-6
# Different known identifiers a context must have, and the score it must reach.
SUPPORT = 3
CONFIDENT = 0.8


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


_DOMAIN = re.compile(FORMS["email"].partition("@")[2])
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email form, found from their signs, so that long words cost no more."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            upto = domain.end()
            yield start, upto
        at = text.find("@", max(at + 1, upto))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the fixed forms, by start and then kind."""
    found = [(a, "email", b) for a, b in _emails(text)]
    if "+" in text:
        for m in re.finditer(FORMS["phone"], text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    if re.search("[0-9][0-9 .-]", text):
        # begun inside a run of digits it could only fail again
        for m in re.finditer("(?<![0-9])" + FORMS["ip"], text):
            parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                found.append((m.start(), "ip", m.end()))
        for m in re.finditer(FORMS["card"], text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), "card", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_HINT = re.compile(r"[0-9@]|[(\[]at[)\]]")
_AT = re.compile(r"@|\(at\)|\[at\]")
_AFTER_AT = re.compile("[A-Za-z0-9.-]+")
_SHAPES = {kind: re.compile(LOOKS[kind]) for kind in KINDS if kind != "email"}
# What stands between the members of a list.
_BETWEEN = " \t\r\n,;|/"


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the looks of an email, found from their signs, so that long words cost no more."""
    upto = 0
    for sign in _AT.finditer(text):
        start = sign.start()
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        rest = _AFTER_AT.match(text, sign.end()) if start < sign.start() else None
        if rest:
            upto = rest.end()
            yield start, upto


def _shaped(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of everything that looks like an identifier and overlaps nothing taken.

    The whole text is searched for one kind after the other; a place belongs to
    the first kind that finds it.
    """
    held = bytearray(len(text))
    for a, b in taken:
        held[a:b] = b"\1" * (b - a)
    out = []
    for kind in KINDS:
        found = _addresses(text) if kind == "email" else (m.span() for m in _SHAPES[kind].finditer(text))
        for a, b in found:
            if b - a >= 6 and not any(held[a:b]):
                held[a:b] = b"\1" * (b - a)
                out.append((kind, a, b))
    return out


def _contexts(text: str, places: list[tuple[int, int]]) -> list[str]:
    """The words before each of the ordered places, in lower case, numbers masked.

    Of a word its last ``TAIL`` characters count. Places that only a separator
    sets apart are a list and share the context of its first member.
    """
    words = [m.span() for m in re.finditer(r"\S+", text)] if places else []
    starts = [start for start, _ in words]
    out, last, shared = [], 0, None
    for a, b in places:
        if shared is None or text[last:a].strip(_BETWEEN):
            at = bisect_right(starts, a) - 1
            before = [*words[max(0, at - CONTEXT) : at], (starts[at], a)]
            pieces = [text[max(start, end - TAIL) : end] for start, end in reversed(before) if start < end][:CONTEXT]
            shared = " ".join(re.sub("[0-9]+", "0", piece.lower()) for piece in reversed(pieces))
        out.append(shared)
        last = max(last, b)
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, base, n_email, n_ip, n_card, n_phone, mentions`` of every document.

    ``base`` are the spans of the fixed forms. ``mentions`` are these and
    everything else that looks like an identifier, however long the word it
    stands in and however many there are, with the words before it.
    """
    mention = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()),
         ("instance", pa.string()), ("pattern", pa.string())]
    )

    def find(text: str) -> tuple:
        base = base_spans(text)
        out = [(kind, a, b, True) for a, kind, b in base]
        if _HINT.search(text):
            out += [(*found, False) for found in _shaped(text, [(a, b) for a, _, b in base])]
        out.sort(key=lambda m: (m[1], KINDS.index(m[0])))
        patterns = _contexts(text, [(a, b) for _, a, b, _ in out])
        rows = [
            {"kind": k, "start": a, "end": b, "known": known, "instance": text[a:b].lower(), "pattern": pattern}
            for (k, a, b, known), pattern in zip(out, patterns)
        ]
        counts = [sum(kind == k for _, kind, _ in base) for k in KINDS]
        return written(base), *counts, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = list(zip(*(find(text or "") for text in part.column("text").to_pylist())))
                kinds = [pa.string()] + [pa.int64()] * 4 + [pa.list_(mention)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")] + [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "base", *(f"n_{k}" for k in KINDS), "mentions"],
                )

    schema = (
        "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, mentions array<struct<"
        "kind: string, start: int, end: int, known: boolean, instance: string, pattern: string>>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def learned_patterns(
    found: DataFrame, rounds: int | None = None, support: int = SUPPORT, confident: float = CONFIDENT
) -> tuple[DataFrame, DataFrame]:
    """Patterns and new instances with the scores they end with.

    ``found(kind, instance, pattern, known)``, one row per mention. Patterns and
    instances of a kind make a graph with one edge per pair. Instances of fixed
    forms score 1 throughout. In each round a pattern scores the mean of its
    instances (up to one instance of score 0 is added, so that few cannot make it
    sure, but no more than lets ``support`` known ones reach ``confident``), and a
    new instance scores 1 less the chance that all its patterns are wrong.

    Rounds go on until no score changes. A pattern's new instances end at no less
    than its own score, so it ends at no less than its known instances alone give
    it; scores begin there and only rise, by a smaller step each round. New
    instances of one pattern alone have its own score and are left out of its
    mean, which gives the same end at once, however many they are. With
    ``rounds`` there are so many, and new instances begin at 0. Sums over edges
    combine before they are shuffled, and an edge is written once, so a pattern in
    a third of all rows stays spread.
    """
    edges = found.where("pattern <> ''").groupBy("kind", "pattern", "instance").agg(F.max("known").alias("known"))
    edges = stored(edges, "pattern-edges")
    # a pattern must have enough known instances to count at all
    grounded = (
        edges.groupBy("kind", "pattern")
        .agg(F.sum(F.col("known").cast("int")).alias("n_known"))
        .where(F.col("n_known") >= support)
    )
    # as much as lets a pattern of that support be sure
    added = min(1.0, support * (1 - confident) / confident) if confident else 1.0
    patterns = stored(
        grounded.select("kind", "pattern", (F.col("n_known") / (F.col("n_known") + added)).alias("confidence")),
        "pattern-scores",
    )
    edges = stored(edges.join(patterns, ["kind", "pattern"], "left_semi"), "grounded-edges")

    def made(patterns: DataFrame) -> DataFrame:
        wrong = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        scores = (
            edges.select("kind", "pattern", "instance", "known")
            .join(patterns.select("kind", "pattern", "confidence"), ["kind", "pattern"])
            .groupBy("kind", "instance")
            .agg(
                F.max("known").alias("known"),
                (1 - F.exp(F.sum(wrong))).alias("made"),
                (F.count(F.lit(1)) == 1).alias("lone"),
            )
        )
        score = F.when(F.col("known"), 1.0).otherwise(F.col("made"))
        lone = F.lit(rounds is None) & F.col("lone") & ~F.col("known")
        return stored(
            scores.select("kind", "instance", "known", score.alias("score"), lone.alias("lone")), "instance-scores"
        )

    if rounds is None:
        instances = made(patterns)
    else:
        instances = edges.groupBy("kind", "instance").agg(F.max("known").alias("known"))
        first = instances.withColumns({"score": F.col("known").cast("double"), "lone": F.lit(False)})
        instances = stored(first, "instance-scores")
    for _ in count() if rounds is None else range(rounds):
        before = patterns.select("kind", "pattern", F.col("confidence").alias("before"))
        patterns = (
            edges.select("kind", "pattern", "instance")
            .join(instances, ["kind", "instance"])
            .groupBy("kind", "pattern")
            .agg((F.sum(F.when(~F.col("lone"), F.col("score"))) / (F.count_if(~F.col("lone")) + added)).alias("confidence"))
        )
        patterns = stored(patterns.join(before, ["kind", "pattern"]), "pattern-scores")
        instances = made(patterns)
        if rounds is None:
            change = patterns.agg(F.max(F.abs(F.col("confidence") - F.col("before")))).first()[0]
            if (change or 0) < SETTLED:
                break
    confident -= SETTLED
    sure = patterns.where(F.col("confidence") >= confident)
    new = instances.where(~F.col("known") & (F.col("score") >= confident))
    return sure, new


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document.

    Mentions of the fixed forms are seeds. The words before them are patterns,
    which are scored together with the instances they introduce, see
    ``learned_patterns``. A word that looks like an identifier is added where a
    confident pattern introduces it, and wherever else an instance stands that
    confident patterns made sure of. Base spans always stay; added ones never
    overlap them.

    Null and empty texts have no spans. Ids may be null. Repeated rows get equal
    results and count as one document would each. An empty table gives no rows.
    Only ``doc_id`` and ``text`` are read.
    """
    marked = stored(mentions(docs).withColumn("row", F.monotonically_increasing_id()), "mentions")
    every = marked.select("row", F.inline("mentions"))
    sure, new = learned_patterns(every.select("kind", "instance", "pattern", "known"), **options)
    unknown = every.where(~F.col("known")).select("row", "kind", "start", "end", "instance", "pattern")
    by_pattern = unknown.join(sure.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
    by_instance = unknown.join(new.select("kind", "instance"), ["kind", "instance"], "left_semi")
    place = ["row", "kind", "start", "end"]
    added = by_pattern.select(*place).unionByName(by_instance.select(*place)).distinct()
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    order = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(order, F.split(s, ":")[0]).cast("int").alias("place"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    more = F.transform(
        F.col("added"),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(order, s["kind"]).cast("int").alias("place"),
            s["end"].alias("end"),
        ),
    )
    both = F.transform(
        F.array_sort(F.concat(base, more)),
        lambda s: F.concat_ws(
            ":", F.element_at(order, s["place"]), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return marked.join(added, "row", "left").select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2("base", 256).alias("base_sha256"),
        F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(both, ",")).alias("spans"),
    )
