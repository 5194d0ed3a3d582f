"""Segmentation against plain rules, on made texts and, through the registered queries, on the smallest tables."""

import random
import re
import time

import pytest

from docloom.operators import segmenting as S
from docloom.plans import catalogues

PIECES = (
    ["Word", "word", "e.g.", "No.", "(approx.", "9.", "12.1.", "iv.", "end.", "Stop!", 'why?"', "(See", "\n", "\n\n", "\n \n", "| a | b |\n", "|---|---|\n", "| 1 | 2 |\n"]
    + ["- item\n", "Title\n\n", "x", "N", "  ", "\t", "etc..", "Dr.)", '"Now"', "a)", "1)", "A.", "7"]
)


def made(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def query(spark, sf, name):
    return next(c.queries[name] for c in catalogues() if name in c.queries)(spark, sf).collect()


def plain_sentences(text):
    """Word by word: one that closes a sentence, before one that can open one."""
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
    out = []
    for i, ((_, a), (at, b)) in enumerate(zip(words, words[1:], strict=False)):
        body = a.rstrip("\"')]")
        if not body or body[-1] not in ".?!" or not (b[0].isascii() and (b[0].isupper() or b[0].isdigit()) or b[0] in "\"'(["):
            continue
        numbers = i == 0 and re.fullmatch(r"(?i)\(?(\d{1,3}(\.\d{1,3})*|[ivxlcdm]{1,4}|[a-z])\)?\.", body)
        if not numbers and not (body[-1] == "." and body.lower().rstrip(".?!\"')]").lstrip("([\"'") in S.ABBREVIATIONS):
            out.append(at)
    return out


def test_sentences():
    for t in made(4000, 1):
        assert S.sentence_cuts(t) == plain_sentences(t), t


def test_sentences_of_the_query(spark, sf, texts):
    got = {}
    for r in query(spark, sf, "sentence_spans"):
        got.setdefault(r.doc_id, []).append(r.cut)
    assert {i: sorted(c) for i, c in got.items()} == {i: c for i, t in texts.items() if (c := plain_sentences(t))}


def plain_layout(text):
    out, at = [], 0
    for block in re.split(r"(\n(?:[^\S\n]*\n)+)", "\n" + text + "\n"):
        lines = [(m.start(), m[0]) for m in re.finditer(r"[^\n]+", block) if m[0].strip()]
        if lines:
            low, high = at + lines[0][0] - 1, at + lines[-1][0] + len(lines[-1][1]) - 1
            if all(x.lstrip()[0] == "|" for _, x in lines):
                out.append((low, high, "table"))
            elif S.LIST_LINE.match(lines[0][1]):
                out += [(at + a - 1, at + a - 1 + len(x), "list_item") for a, x in lines]
            else:
                out.append((low, high, "heading" if len(lines) == 1 and S.is_heading(lines[0][1]) else "paragraph"))
        at += len(block)
    return out


def test_layout(texts):
    for t in [*made(2000, 2), *texts.values()]:
        assert S.text_layout(t) == plain_layout(t), t


def plain_spans(text, least=2):
    """Marks joined one by one, from the right: fragments to the left, headings to what follows."""
    if not text:
        return []
    at = []
    for a, b, kind in plain_layout(text) or [(0, 0, "other")]:
        at.append((a, kind))
        if kind == "table":
            lines = [m for m in re.finditer(r"[^\n]+", text[a:b])]
            at += [(a + m.start(), "table_row") for m in lines[1:] if set(m[0]) - set(" \t:|-") or "-" not in m[0]]
        elif kind == "paragraph":
            at += [(a + c, kind) for c in plain_sentences(text[a:b])]
    weigh = lambda i: at[i][1] == "table_row" or len(re.findall(r"[^\W_]", text[at[i][0] : at[i + 1][0] if i + 1 < len(at) else len(text)])) >= least
    begins = []
    for i in reversed(range(1, len(at))):
        head = at[i][1] == "heading"
        if weigh(i) and at[i - 1][1] != "heading" and not (head and not any(map(weigh, range(i + 1, len(at))))) and not (i == 1 and not weigh(0)):
            begins.insert(0, i)
    kinds = [at[1 if len(at) > 1 and not weigh(0) else 0][1], *(at[i][1] for i in begins)]
    edges = [0, *(at[i][0] for i in begins), len(text)]
    return list(zip(edges, edges[1:], kinds, strict=False))


def test_spans():
    for t in made(2000, 3):
        assert S.spans_of(t) == plain_spans(t), t


def test_spans_of_the_query(spark, sf, texts):
    got = {}
    for r in query(spark, sf, "layout_segments"):
        got.setdefault(r.chunk_id, []).append((r.n, r.start, r.end, r.kind))
    small = {i: t for i, t in texts.items() if len(t) < 5000}
    want = {f"d{i}": [(n, a, b, k) for n, (a, b, k) in enumerate(plain_spans(t)) if t[a:b].strip()] for i, t in small.items()}
    assert len(small) > 100 and all(sorted(got.get(i, [])) == w for i, w in want.items())


def plain_split(text, cap):
    """For each piece, all places where it could end, best by what is there and then by how late it is."""
    out, at, head = [], 0, ""
    while at < len(text):
        room = cap - 1 - len(head)
        if len(text) - at <= room:
            return [*out, head + text[at:]]
        places = [(0, at + room, at + room)]
        for p in range(at + (0 if head else 1), at + room):
            if text[p : p + 2] == "\n\n" and p + 2 <= at + room and p - at + len(head) >= cap // 2:
                places.append((3, p, p + 2))
            if text[p] == "\n":
                places.append((2, p, p + 1))
            if text[p] in " \t":
                places.append((1, p, p + 1))
        _, end, go_on = max(places)
        out.append(head + text[at:end])
        head, at = "", go_on
        before = out[-1].split("\n")
        while before and before[0].lstrip(" \t")[:1] != "|":
            before.pop(0)
        rows = before if text[end:go_on] == "\n" and all(x.lstrip(" \t")[:1] == "|" for x in before) else []
        if len(rows) > 1 and S.is_rule(rows[1]) and text[go_on:].lstrip(" \t")[:1] == "|" and len(f"{rows[0]}\n{rows[1]}") < cap // 2:
            head = f"{rows[0]}\n{rows[1]}\n"
    return out


def test_hard_split_of_prose_and_tables():
    rng = random.Random(5)
    row = lambda i: f"| {i} | v{i * 7} |"
    for _ in range(300):
        prose = "\n".join(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) + "\n" * rng.randint(0, 1) for _ in range(rng.randint(0, 6)))
        table = "\n".join(["| h1 | h2 |", "|---|---|", *map(row, range(rng.randint(0, 40)))])
        text = f"{prose}\n\n{table}"
        for cap in (64, 90, 200):
            got = S.hard_split(text, cap)
            assert got == plain_split(text, cap) and all(len(p) < cap for p in got)
            assert [x for p in got for x in p.split("\n") if " v" in x] == [x for x in table.split("\n") if " v" in x]


def test_hard_split_of_the_query(spark, sf, texts):
    got = {}
    for r in query(spark, sf, "hard_split"):
        got.setdefault(r.doc_id, []).append((r.n, r.size))
    want = {i: [(n, len(p)) for n, p in enumerate(plain_split(t, 2000))] for i, t in texts.items() if t.strip()}
    assert {i: sorted(x) for i, x in got.items()} == want


def test_units_of_the_query(spark, sf, texts):
    """Span by span: furniture has no kind here, so a unit begins at each heading or table, at the first span, and after a
    table's last row; its texts are joined up to the cap."""
    got = {(r.doc_id, r.unit, r.part): r.size for r in query(spark, sf, "group_units")}
    want = {}
    for i, t in texts.items():
        units, before = [], None
        for a, b, kind in S.spans_of(t):
            if len(re.findall(r"[^\W_]", t[a:b])) < 2:
                continue
            if before is None or kind in S.STARTS or (before == "table_row" and kind != "table_row"):
                units.append([])
            units[-1].append((kind, t[a:b].strip()))
            before = kind
        for u, spans in enumerate(units):
            head = spans[0][1] if any(k == "table_row" for k, _ in spans) else ""
            parts = [[]]
            for _, x in spans:
                if parts[-1] and len("\n".join([*([head] if head and len(parts) > 1 else []), *parts[-1], x])) > 6000:
                    parts.append([])
                parts[-1].append(x)
            for p, xs in enumerate(parts):
                want[i, u, p] = len("\n".join(([head] if head and p else []) + xs))
    assert got == want


def test_wrapped_lines_of_the_query(spark, sf, texts):
    got = {}
    for r in query(spark, sf, "wrapped_merge"):
        got.setdefault(r.doc_id, []).append((r.item, r.text))
    want = {}
    for i, t in texts.items():
        items = []
        last = None
        for line in t.split("\n"):
            if not line.strip():
                continue
            plain = not line.startswith("|")
            ended = last is not None and re.search(r"[.!?:;][\"')\]]*\s*$", last[0])
            begins = re.match(r"\s*([A-Z0-9\"'(\[•-]|[^\W\d_a-z])", line) and (line.strip()[0].isupper() or not line.strip()[0].isalpha())
            if last is None or not plain or not last[1] or (ended and begins):
                items.append(line.strip(" "))
            else:
                x = line.strip(" ")
                items[-1] = items[-1][:-1] + x if re.search(r"[^\W\d_]-$", items[-1]) and x[:1].islower() else f"{items[-1]} {x}"
            last = (line, plain)
        if items:
            want[i] = items
    assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == want


def plain_legal(text, least=25):
    """Every position asked whether a provision can begin there."""
    if not text:
        return []
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, min(at + len(line) + 1, len(text)), line.lstrip(" \t").startswith("|")))
        at += len(line) + 1
    tables = []
    for a, b, pipe in lines:
        if pipe and tables and tables[-1][1] == a and tables[-1][2]:
            tables[-1] = (tables[-1][0], b, True, tables[-1][3] + 1)
        else:
            tables.append((a, b, pipe, 1))
    tables = [(a, b) for a, b, pipe, n in tables if pipe and n > 1]

    marks, at = set(), 0
    while at < len(text):  # from left to right, none inside another
        m = re.match(r"(\(\s{0,3}([a-zA-Z]|[ivxlcdm]{1,4}|\d{1,3})\s{0,3}\)|([a-zA-Z]|[ivxlcdm]{1,4}|\d{1,3})\)|\d+(\.\d+){1,3}\.?|§+)\s+(?=[A-Z\"'(])", text[at:])
        if m and (not at or text[at - 1].isspace() or text[at - 1] in ".;:"):
            marks.add(at)
            at += m.end()
        else:
            at += 1

    def begins(i):
        before, after = text[:i], text[i:]
        if any(a < i < b for a, b in tables):
            return False
        if any(i in ab for ab in tables) or before.endswith("\n") and not after.startswith("\n"):
            return True
        if i in marks:
            return True
        gap = re.search(r"([.;:])\s+$", before)
        if not gap or not re.match(r"[A-Z\"'(]", after):
            return False
        word = re.search(r"[A-Za-z.]+$", before[: gap.start()])
        return gap[1] != "." or not (before[gap.start() - 1 : gap.start()].isdigit() or word and word[0].strip(".").lower() in S.LEGAL_ABBREVIATIONS)

    edges = [0, *(i for i in range(1, len(text)) if begins(i)), len(text)]
    out, a = [], 0
    for b in edges[1:]:
        if b == len(text) or not S.short_or_heading(text[a:b], least):
            out.append((a, b))
            a = b
    if len(out) > 1 and S.short_or_heading(text[out[-1][0] : out[-1][1]], least):
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def test_legal_spans(texts):
    one = "1. Term\nThis Agreement runs for two years from the date, under Sec. 12.1 hereof. It renews; Provided that (a) The parties agree. (b) No notice is given to Acme Inc. of New York."
    spans = [one[a:b] for a, b, _ in S.legal_spans_of(one)]
    assert spans[0].startswith("1. Term\nThis Agreement") and spans[0].endswith("hereof. ") and spans[-1].startswith("(b) No notice") and spans[-1].endswith("New York.")
    table = "Fees are listed in the schedule below.\n| a | b |\n|---|---|\n| 1 | 2. Next |\nThe end of the schedule is here."
    assert [k for *_, k in S.legal_spans_of(table)] == ["provision", "table", "provision"]
    few = [t for t in texts.values() if len(t) < 1500]
    for t in [one, table, *made(400, 6), *few]:
        got = S.legal_spans_of(t)
        assert "".join(t[a:b] for a, b, _ in got) == t and [(a, b) for a, b, _ in got] == plain_legal(t), t
    assert S.legal_spans_of("") == []


@pytest.mark.parametrize("text", ["The quick brown fox. Jumps over (e.g. it) the dog. " * 20_000, " " * 1_000_000, "a" * 1_000_000, "." * 1_000_000, "\n" * 1_000_000, "-" * 1_000_000 + "x", "| a " * 250_000])
def test_long_texts_take_no_time(text):
    began = time.time()
    S.spans_of(text), S.hard_split(text, 24_000), S.legal_spans_of(text)
    assert time.time() - began < 2
