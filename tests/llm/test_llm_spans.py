import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cuesift.llm import personal, substrings
from cuesift.llm.arrays import flat
from cuesift.llm.lines import document_lines, line_dedup, placed_lines, recurring_lines
from cuesift.llm.personal import FORMS, KINDS, base_spans, learned_patterns, mentions, personal_data, written


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind in KINDS:
        for m in re.finditer(FORMS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


@given(st.lists(st.sampled_from(
    ["a@b.co", "@", "x.y+z@", "m-1.n", ".", "1.2.3.4", "10.0.0.256", "4111 1111-1111 1111", "+1 (555) 010-9999", " ", "é", "7", "99", "-", "+"]
), max_size=9))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_the_plain_forms(parts):
    text = "".join(parts)
    assert base_spans(text) == plain_spans(text)


def test_long_runs_take_no_longer_than_their_length():
    assert base_spans("a" * 200_000 + " @ " + "1" * 200_000 + "." + "0" * 6000 + ".1.1") == []
    assert base_spans("0" * 6000 + ".1.1.1") == [(0, "ip", 6006)]
    assert personal.base_spans("9" * 200_000) == []


def test_contexts_discover_unseen_identifiers(spark, odd, empty):
    rows = [(200 + i, f"please contact me at user{i}@mail.example.org today") for i in range(12)]
    rows += [(100, "please contact me at hidden(at)mail.example.org soon"), (101, "see hidden(at)mail.example.org there")]
    rows += [(102, "growth was 12-34-56-78 in that year"), (103, None), (104, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert len(personal_data(docs).collect()) == docs.count()
    assert got[100].spans == "email:21:47" and got[100].n_email == 0
    assert got[101].spans == "email:4:30"  # the same instance, without the context
    assert got[102].spans == "" and got[103].spans == ""
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, text in rows[:12]:
        base = written(plain_spans(text))
        assert got[i].spans == base and got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert personal_data(empty).collect() == []


def test_pattern_scores_match_brute_force(spark):
    draw = random.Random(4)
    found = [
        ("email", f"i{draw.randrange(40)}", f"p{draw.randrange(9)}", False) for _ in range(160)
    ]
    found = [(k, i, p, int(i[1:]) < 25) for k, i, p, _ in found]
    frame = spark.createDataFrame(found, "kind string, instance string, pattern string, known boolean")
    sure, new = learned_patterns(frame, rounds=3, support=2, confident=0.0)
    edges = {(p, i): k for _, i, p, k in found}
    known_of = collections.Counter(p for (p, i), k in edges.items() if k)
    edges = {e: k for e, k in edges.items() if known_of[e[0]] >= 2}
    score = {i: float(k) for (_, i), k in edges.items()}
    for _ in range(3):
        members = collections.defaultdict(list)
        for p, i in edges:
            members[p].append(score[i])
        pattern = {p: sum(v) / (len(v) + 1) for p, v in members.items()}
        wrong = collections.defaultdict(lambda: 1.0)
        for p, i in edges:
            wrong[i] *= 1 - pattern[p]
        score = {i: 1.0 if k else 1 - wrong[i] for (_, i), k in edges.items()}
    assert {r.pattern: round(r.confidence, 9) for r in sure.collect()} == {p: round(v, 9) for p, v in pattern.items()}
    want = {i: round(score[i], 9) for (_, i), k in edges.items() if not k}
    assert {r.instance: round(r.score, 9) for r in new.collect()} == want


def test_scores_settle_however_many_identifiers_are_unseen(spark):
    # pattern: known, unseen of its own
    sizes = {"few": (3, 0), "three": (3, 1), "many": (20, 40), "hot": (3, 3000), "two": (2, 1)}
    found = [("phone", f"{p}-{i}", p, i < k) for p, (k, m) in sizes.items() for i in range(k + m)]
    found += [("phone", f"both-{i}", p, False) for i in range(50) for p in ("three", "hot")]
    frame = spark.createDataFrame(found, "kind string, instance string, pattern string, known boolean")
    sure, new = learned_patterns(frame)
    score = {r.pattern: r.confidence for r in sure.collect()}
    assert set(score) == {"few", "three", "many", "hot"}
    assert abs(score["few"] - 3 / 3.75) < 1e-5 and abs(score["many"] - 20 / 20.75) < 1e-5
    assert 0.8 < score["hot"] < 1 and abs(score["hot"] - score["three"]) < 1e-6
    got = {r.instance for r in new.collect()}
    assert got == {i for _, i, p, known in found if not known and p != "two"}


def test_few_known_identifiers_suffice(spark):
    rows = [(i, f"reach me at user{i}@mail.example.org") for i in range(3)]
    rows += [(100 + i, f"reach me at hidden{i}(at)mail.example.org") for i in range(40)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans != "" for r in got} == {i: True for i, _ in rows}


def test_lists_and_long_words_are_searched_whole(spark):
    """Any number of identifiers in a word, and words of any length."""
    rows = [(i, f"reach me at user{i}@mail.example.org") for i in range(5)]
    long = "x" * 130 + "(at)" + "y" * 130 + ".org"
    tail = "zz" * 5000
    rows += [
        (10, "reach me at bob(at)y.org,eve(at)z.org"),
        (11, f"reach me at {long}"),
        (12, f"{tail} reach me at ann(at)y.org; tom@known.example.org, kim[at]w.org {tail}"),
        (13, "another text of eve2(at)z.org only"),
        (14, "reach   \n  me " + " " * 200 + "at lou(at)y.org"),
    ]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)

    def found(doc):
        return [texts[doc][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[doc].split(",") if s)]

    assert found(10) == ["bob(at)y.org", "eve(at)z.org"]
    assert found(11) == [long]
    assert found(12) == ["ann(at)y.org", "tom@known.example.org", "kim[at]w.org"]
    assert found(13) == [] and found(14) == ["lou(at)y.org"]


def test_mentions_of_long_texts_take_no_longer_than_their_length(spark):
    texts = [(1, "a" * 300_000 + "(at)" * 3), (2, "a@" * 150_000), (3, "1.2.3.4 " * 40_000), (4, "12-34" * 60_000), (5, "9" * 300_000)]
    rows = mentions(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id").collect()
    assert len(rows) == 5


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefé") for _ in range(draw.randrange(2, 8))) for _ in range(n))


def test_cuts_follow_the_content():
    draw = random.Random(1)
    passage = prose(draw, 300)

    def pieces(text):
        data, bounds = flat(pa.array(["other row", text]))
        begin = [b for b in substrings.cuts(data, bounds) if b >= bounds[1]]
        ends = [*begin[1:], len(data)]
        return [data[a:b].tobytes() for a, b in zip(begin, ends)]

    whole = pieces(passage)
    assert b"".join(whole).decode() == passage
    assert all(p.decode() and len(p) <= substrings.MOST + 3 for p in whole)
    moved = pieces(prose(draw, 7) + passage)
    assert len(set(whole) & set(moved)) >= len(whole) - 3
    assert b"".join(pieces("z" * 5000)).decode() == "z" * 5000
    assert len(substrings.cuts(*flat(pa.array([None, ""])))) == 0


def test_substrings_keep_one_copy(spark, odd, empty):
    draw = random.Random(2)
    passage = prose(draw, 70)
    line = prose(draw, 9)
    rows = [(i, f"{prose(draw, 40)} {passage} {prose(draw, 40)}") for i in range(6)]
    rows += [(10 + i, f"{line}\n{prose(draw, 60)}") for i in range(6)] + [(30, rows[0][1]), (31, "tiny text"), (32, "tiny text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substrings.substring_dedup(docs).collect()}
    texts = dict(rows)
    assert got[0].text == texts[0] and got[31].text == "tiny text"
    for i in range(1, 6):
        assert got[i].removed_words >= 40 and 0 in got[i].first_ids
        (span,) = got[i].spans
        assert texts[i][span.begin : span.end] in passage + " " + passage
        assert got[i].text == texts[i][: span.begin] + texts[i][span.end :]
    for i in range(10, 16):
        assert got[i].text == texts[i] and not got[i].spans
    assert got[30].text == "" and got[32].text == ""
    found = substrings.substring_dedup(odd).collect()
    assert len(found) == odd.count()
    prose_rows = [r for r in found if r.doc_id in (1, 2)]
    assert sum(r.text != "" for r in prose_rows) == 1
    assert substrings.substring_dedup(empty).collect() == []


def test_short_passages_go_to_their_last_word(spark):
    draw = random.Random(5)
    own = collections.defaultdict(list)
    rows = []
    for i in range(300):
        passage = prose(draw, 51)
        own[passage] = [(prose(draw, 40), prose(draw, 40)) for _ in range(2)]
        rows += [(2 * i + n, f"{before} {passage} {after}") for n, (before, after) in enumerate(own[passage])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substrings.substring_dedup(docs).collect()}
    whole = sum(r.removed_words >= 51 for i, r in got.items() if i % 2)
    assert whole >= 299
    for i, (passage, pairs) in enumerate(own.items()):
        before, after = pairs[1]
        assert got[2 * i].text == rows[2 * i][1]
        left = got[2 * i + 1]
        if left.removed_words == 51:
            assert left.text == f"{before}  {after}" and left.first_ids == [2 * i]
            assert [(s.begin, s.end) for s in left.spans] == [(len(before) + 1, len(before) + 1 + len(passage))]


def test_passages_are_followed_beyond_what_is_read_at_first(spark):
    draw = random.Random(6)
    # the chunks of the middle stand first elsewhere, so only the ends of the passage stand first in 2
    middle, ends = prose(draw, 900), [prose(draw, 30), prose(draw, 30)]
    passage = f"{ends[0]} {middle} {ends[1]}"
    rows = [(1, f"{prose(draw, 20)} {middle} {prose(draw, 20)}")]
    rows += [(i, f"{prose(draw, 20)} {a}{passage}{b} {prose(draw, 20)}") for i, a, b in ((2, "x", "y"), (3, "q", "r"))]
    rows += [(4, "few shared words only " + ends[0][: len(ends[0]) // 3]), (5, "  "), (6, "  ")]
    found = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got, texts = {r.doc_id: r for r in found}, dict(rows)
    assert got[1].text == texts[1] and got[4].text == texts[4] and got[5].text == "  " and got[6].text == ""
    assert got[2].removed_words == 900 and got[2].first_ids == [1]
    (span,) = got[3].spans
    inside = passage[passage.index(" ") + 1 : passage.rindex(" ")]  # the outermost words are others in 2
    assert texts[3][span.begin : span.end] == inside and got[3].first_ids == [1, 2]


def expected_lines(rows, least, similarity):
    """The same tree without Spark."""
    split = lambda t: re.split(r"\r\n|\r|\n", t or "")
    mask = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09\x0b\x0c]+", line) if t)
    where = collections.defaultdict(set)
    for key in set(rows):
        for line in split(key[1]):
            if mask(line):
                where[mask(line)].add(key)
    branches = collections.defaultdict(list)
    for line in where:
        branches[len(line), line[:3]].append(line)
    gone = set()
    for lines in branches.values():
        support = collections.defaultdict(set)
        for line in lines:
            for at, token in enumerate(line):
                support[at, token] |= where[line]
        often = lambda at, t: t != "<*>" and len(support[at, t]) >= least
        kept = {line: tuple(t if often(at, t) else "<*>" for at, t in enumerate(line)) for line in lines}
        fixed = {line: sum(often(at, t) for at, t in enumerate(line)) / len(line) for line in lines}
        total = collections.defaultdict(set)
        for line in lines:
            if fixed[line] >= similarity:
                total[kept[line]] |= where[line]
        gone |= {line for line in lines if fixed[line] >= similarity and len(total[kept[line]]) >= least}
    return {key: [line for line in split(key[1]) if mask(line) not in gone] for key in set(rows)}


def test_recurring_lines_match_brute_force(spark, odd, empty):
    draw = random.Random(8)
    names = ["anna", "bela", "carl", "dora"]
    rows = []
    for i in range(60):
        lines = [prose(draw, draw.randrange(1, 9)) for _ in range(4)]
        if i % 2:
            lines.append(f"Posted by user {draw.choice(names)}{i} on the board at {i}:30 today with all thanks")
        if i % 3 == 0:
            lines.append(f"  Read more about {draw.choice(names)} in the weekly news letter of our town hall ")
        draw.shuffle(lines)
        rows.append((i, draw.choice(["\n", "\r\n"]).join(lines)))
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected_lines(rows, 10, 0.8)
    got = line_dedup(docs, min_documents=10).collect()
    assert len(got) == len(rows)
    assert any(r.n_dropped for r in got)
    for r in got:
        stay = want[r.doc_id, dict(rows)[r.doc_id]]
        assert r.n_dropped == r.n_lines - len(stay)
        assert re.split(r"\r\n|\r|\n", r.text) == stay
    templates = {r.template for r in recurring_lines(docs, placed_lines(docs), 10).collect()}
    assert any("<*>" in t for t in templates)
    found = line_dedup(odd, min_documents=2).collect()
    assert len(found) == odd.count() and all(r.text is None for r in found if r.doc_id == 3)
    assert line_dedup(empty).collect() == []


def test_lines_end_in_every_form(spark):
    """CR, LF and CR LF end lines; lines without tokens have their places and stay."""
    ends = ["\r", "\n", "\r\n", "\n\r", "\r\r\n", "\n\n"]
    shared = ["the same words in all", " \t\x0b ", "read  more\tabout 12 towns today"]
    rows = [(i, ends[i % 6] + ends[i % 6].join([f"own line {'abcdefghijkl'[i]} only", *shared]) + ends[i % 4]) for i in range(12)]
    rows += [(20, ""), (21, "\r"), (22, "\x0b\r\n\x0c"), (23, shared[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected_lines(rows, 10, 0.8)
    for r in line_dedup(docs, 10).collect():
        text = dict(rows)[r.doc_id]
        split = re.split(r"\r\n|\r|\n", text)
        stay = want[r.doc_id, text]
        assert (r.n_lines, r.n_dropped) == (len(split), len(split) - len(stay))
        assert r.text == (text if len(stay) == len(split) else "\n".join(stay))


def test_texts_are_split_and_lines_masked_once(spark, odd):
    """Neither an inferred filter nor the one of empty lines does the work of the columns again."""
    plan = document_lines(odd)._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line for line in plan.split("\n") if line.strip()]
    assert not any("Filter" in node and ("<*>" in node or "split(" in node) for node in nodes)
    assert sum("<*>" in node for node in nodes) == 1


def test_lines_of_one_document_and_of_numbers_stay(spark):
    """What is alike only inside a document, or only in being numbers, is no template."""
    draw = random.Random(5)
    alone = "\n".join(f"alpha beta gamma {w} delta" for w in "one two three four five six seven eight nine ten".split())
    rows = [(0, alone)]
    rows += [(i, f"{prose(draw, 9)}\n{i}.5 {i * 7} {1900 + i}\n{prose(draw, 8)}") for i in range(1, 13)]
    rows += [(i, f"{prose(draw, 9)}\nnever miss our {w} story again\nshared line of all") for i, w in zip(range(20, 34), "abcdefghijklmn")]
    # nine documents hold the middle words of a line in many forms: one too few
    rows += [(i, "\n".join(f"kept by nine x{w}y only" for w in "abcd"[i % 3 :])) for i in range(40, 49)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    want = expected_lines(rows, 10, 0.8)
    for key, stay in want.items():
        assert re.split("\n", got[key[0]].text) == stay
    assert all(got[i].n_dropped == 0 for i in [0, *range(1, 13), *range(40, 49)])
    assert all(got[i].n_dropped == 2 for i in range(20, 34))


def test_numpy_runs():
    held = np.array([9, 9, 1, 9, 9, 9])
    assert substrings._runs(np.array([0, 1, 3, 4, 5]), held, 20) == [(3, 6)]
    assert substrings._runs(np.arange(6), held, 1000) == [(0, 6)]
