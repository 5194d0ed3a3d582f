"""From documents to chunks, spans and units.

What is a fold over one text is a Python function of that text, applied by mapInArrow to the rows as they lie: no
shuffle. What runs over the rows of a document is windows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions import spread
from docloom.functions.text import ENUMERATION

#: Abbreviations whose point ends no sentence, kinds of layout items, an item's number and a list's line.
ABBREVIATIONS = "e.g i.e etc vs cf approx appr ca no nos ref req fig figs dia min max avg std vol est dept mr mrs ms dr st jr sr inc ltd co".split()
PROSE = ("paragraph", "caption", "footnote", "other")
FURNITURE = ("page_header", "page_footer")
STARTS = ("heading", "title", "table")
LAYOUT_KINDS = {
    "section_header": "heading", "heading": "heading", "title": "title", "table": "table", "list_item": "list_item", "text": "paragraph", "paragraph": "paragraph",
    "caption": "caption", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer", "picture": "picture", "formula": "formula", "code": "code",
}
LIST_NUMBER = r"\(?(?:\d{1,3}(?:\.\d{1,3})*|[ivxlcdm]{1,4}|[a-z])\)?\."
LIST_LINE = re.compile(r"\s*(?:[-*•]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
HEADS = ("heading", "title")
CLOSERS = r"[\"')\]]*"
#: What a scan over prose meets: a number that opens it or an abbreviation, each with its point, which are passed over,
#: or else (group 1) the space between a terminator with its closers and whatever can open a sentence.
SENTENCE_GAP = re.compile(
    rf"\A\s*(?i:{LIST_NUMBER}){CLOSERS}(?=\s)"
    rf"|(?<!\S)[(\[\"']*(?i:{'|'.join(map(re.escape, sorted(ABBREVIATIONS, key=len, reverse=True)))})[.?!\"')\]]*\.{CLOSERS}(?=\s)"
    rf"|[.?!]{CLOSERS}(\s+)(?=[A-Z0-9\"'(\[])"
)
#: Abbreviations whose point ends no provision, and the marks that open one.
LEGAL_ABBREVIATIONS = "inc corp co ltd llc llp plc no nos art sec secs para paras cf vs v mr mrs ms dr st ave etc al viz e.g i.e u.s u.s.c".split()
ENUMERATED = re.compile(r"(?:(?<=\s)|(?<=[.;:])|\A)(\(\s{0,3}(?:[a-zA-Z]|[ivxlcdm]{1,4}|\d{1,3})\s{0,3}\)|(?:[a-zA-Z]|[ivxlcdm]{1,4}|\d{1,3})\)|\d+(?:\.\d+){1,3}\.?|§+)\s+(?=[A-Z\"'(])")
#: An abbreviation or a number's point, passed over, or else (group 1) the mark and space between two provisions.
PROVISION_GAP = re.compile(rf"(?<![A-Za-z.])\.{{0,3}}(?i:{'|'.join(map(re.escape, sorted(LEGAL_ABBREVIATIONS, key=len, reverse=True)))})\.+(?=\s)|\d\.(?=\s)|([.;:]\s+)(?=[A-Z\"'(])")
#: Where a text that is too long is best cut, best first, and the share of a piece that must lie before it.
BREAKS = ((re.compile(r"(?s).*(\n\n)"), 0.5), (re.compile(r"(?s).*(\n)"), 0.0), (re.compile(r"(?s).*([ \t])"), 0.0))
#: Two letters or digits, wherever they are.
TWO_ALNUM = r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"
TWO_ALNUM_HERE = re.compile(r"[^\W_][\W_]*[^\W_]")
BLANK = " \t\n\x0b\x0c\r"
PIPE_BLOCK = re.compile(r"(?m)^[ \t]*\|.*(?:\n[ \t]*\|.*)*")
PIPE = re.compile(r"[ \t]*\|")
#: Rows that a task makes, and characters that it reads, before it hands on what it has.
MANY, LONG = 8192, 4_000_000
#: What the Python worker that makes rows does to them at once: the columns that it adds and a function that adds them.
Step = tuple[str, Callable[[pa.RecordBatch], pa.RecordBatch]]


def layout_kind(label: Column) -> Column:
    """The kind of a parser's label, 'other' for those unknown."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LAYOUT_KINDS.items() for x in kv)), F.lower(label)), F.lit("other"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text of the lines with something in them."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "text")).where(F.btrim(F.regexp_replace("text", r"\s+", " ")) != "")


def offsets(parts: DataFrame, by: str = "doc_id", order: str = "pos") -> DataFrame:
    """parts with start and end in the text that joins them with a blank line."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return parts.withColumn("start", start).withColumn("end", start + F.length("text"))


def sections(items: DataFrame, heading: Column) -> DataFrame:
    """Items (doc_id, pos, text) by section: a heading opens one, what stands before the first is section 0. Number: the
    heading's first token if it holds a digit, else the ordinal."""
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = items.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("int")).over(run))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    out = s.groupBy("doc_id", "section").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), body.alias("body"))
    first = F.get(F.split(F.btrim(F.coalesce("title", F.lit(""))), r"\s+"), F.lit(0))
    return out.withColumn("number", F.when(first.rlike("[0-9]"), F.rtrim(first, F.lit("."))).otherwise(F.col("section").cast("string")))


def wrapped(items: DataFrame, is_text: Column) -> DataFrame:
    """Text lines joined where a sentence goes on: a new line starts after one that ends a sentence if it begins one
    itself, and at whatever isn't text. A word hyphenated at a line's end is joined. doc_id, item, text."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    ends = F.col("text").rlike(r"[.!?:;][\"')\]]*\s*$")
    begins = F.col("text").rlike(r"^\s*[\p{Lu}0-9\"'(\[•-]")
    t = items.withColumn("_text", is_text)
    prev_end, prev_text = F.lag(ends).over(w), F.lag("_text").over(w)
    fresh = F.coalesce((prev_end & begins) | ~prev_text | ~F.col("_text"), F.lit(True))
    t = t.withColumn("item", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.btrim(x["text"]))
    joined = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat_ws(" ", acc, x)))
    return t.groupBy("doc_id", "item").agg(joined.alias("text"))


def runs(rows: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """Maximal runs of equal flags: by, first, last, flag."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, flag).orderBy(order))
    return rows.withColumn("_i", island).groupBy(by, flag, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_i")


def boundaries(starts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contiguous ranges from any starts (doc_id, start): those in (0, n) count once, 0 always; sizes: doc_id, n."""
    inner = starts.join(sizes, "doc_id").where("start > 0 and start < n").select("doc_id", "start", "n")
    all_ = inner.unionByName(sizes.select("doc_id", F.lit(0).alias("start"), "n")).distinct()
    w = Window.partitionBy("doc_id").orderBy("start")
    return all_.select("doc_id", "start", F.coalesce(F.lead("start").over(w), F.col("n")).alias("end"))


# one text at a time


def sentence_cuts(text: str) -> list[int]:
    """Where a sentence begins after another one, in one scan: see SENTENCE_GAP."""
    return [m.end(1) for m in SENTENCE_GAP.finditer(text) if m[1]]


def is_rule(row: str) -> bool:
    """Whether a table's row is the line between header and body."""
    return "-" in row and not row.strip(" \t:|-")


def is_heading(row: str) -> bool:
    """Whether a line that stands alone is a heading: short, it begins in upper case, and but for its number it has none of . ; :"""
    return len(row) <= 60 and row.strip()[:1].isupper() and not re.search(r"[.;:]", re.sub(r"^\s*\(?[\dA-Za-z]{1,4}[.)]\s+", "", row))


def blocks(text: str) -> Iterator[tuple[int, list[str]]]:
    """Start and lines of what lies between blank lines."""
    at, begun, held = 0, 0, []
    for line in text.split("\n"):
        if line.strip():
            begun = begun if held else at
            held.append(line)
        elif held:
            yield begun, held
            held = []
        at += len(line) + 1
    if held:
        yield begun, held


def text_layout(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the blocks between blank lines: table, list_item for each line of a list, heading, paragraph."""
    out = []
    for at, rows in blocks(text):
        end = at + sum(map(len, rows)) + len(rows) - 1
        if all(r.lstrip().startswith("|") for r in rows):
            out.append((at, end, "table"))
        elif LIST_LINE.match(rows[0]):
            for r in rows:
                out.append((at, at + len(r), "list_item"))
                at += len(r) + 1
        else:
            out.append((at, end, "heading" if len(rows) == 1 and is_heading(rows[0]) else "paragraph"))
    return out


def marks(text: str) -> Iterator[tuple[int, str]]:
    """Where a span may begin and its kind, from left to right: at each block, inside a table at each row that is no rule,
    inside prose at each sentence."""
    for a, b, kind in text_layout(text):
        yield a, kind
        if kind == "table":
            at = a
            for row in text[a:b].split("\n"):
                if at > a and not is_rule(row):
                    yield at, "table_row"
                at += len(row) + 1
        elif kind in PROSE:
            yield from ((a + c, kind) for c in sentence_cuts(text[a:b]))


def spans_of(text: str, least: int = 2) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that tile the text, from its marks.

    A mark begins a span if what follows up to the next one has `least` letters and digits or is a table's row, unless a
    heading is before it, or it is itself a heading with nothing of that weight behind it. A fragment that opens the text
    goes with what follows, and so gives its place as first to it.
    """
    if not text:
        return []
    at, kinds = zip(*(list(marks(text)) or [(0, "other")]), strict=True)
    enough = re.compile(rf"(?:[\W_]*[^\W_]){{{least}}}").match  # that many letters and digits
    heavy = [k == "table_row" or bool(enough(text, a, b)) for a, b, k in zip(at, (*at[1:], len(text)), kinds, strict=True)]
    last = max((i for i, h in enumerate(heavy) if h), default=-1)
    first = 0 if heavy[0] else 1
    begins = [i for i in range(first + 1, len(at)) if heavy[i] and kinds[i - 1] not in HEADS and not (i == last and kinds[i] in HEADS)]
    edges = [0, *(at[i] for i in begins), len(text)]
    return list(zip(edges[:-1], edges[1:], [kinds[min(first, len(kinds) - 1)], *(kinds[i] for i in begins)], strict=True))


def short_or_heading(text: str, least: int) -> bool:
    """Whether a text can't stand alone: fewer than `least` characters, or a bare heading."""
    bare = text.strip()
    title = re.sub(ENUMERATION, "", bare, count=1)
    return len(bare) < least or len(bare) <= 60 and title[:1].isupper() and not re.search("[.;:]", title)


def legal_spans_of(text: str, least: int = 25) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a contract's text, which they tile: a table of two rows or more is one, elsewhere one ends
    at a line's end, after a point, semicolon or colon before a capital, quote or bracket, and before an enumeration mark.
    What can't stand alone goes with the span that follows, or with the one before if none does."""
    tables = [(m.start(), min(m.end() + 1, len(text))) for m in PIPE_BLOCK.finditer(text) if "\n" in m[0]]
    starts = [a for a, _ in tables]

    def in_table(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i >= 0 and tables[i][0] < at < tables[i][1]

    found = [m.end() for m in re.finditer(r"\n+", text)]
    found += [m.start(1) for m in ENUMERATED.finditer(text)]
    found += [m.end(1) for m in PROVISION_GAP.finditer(text) if m[1]]
    edges = sorted({0, len(text), *(x for ab in tables for x in ab), *(x for x in found if not in_table(x))})
    out: list[tuple[int, int, str]] = []
    begin = 0
    for end in edges[1:]:
        if end == len(text) or not short_or_heading(text[begin:end], least):
            out.append((begin, end, "table" if begin in starts else "provision"))
            begin = end
    if len(out) > 1 and short_or_heading(text[slice(*out[-1][:2])], least):
        out[-2:] = [(out[-2][0], out[-1][1], out[-2][2])]
    return out


def headed_tables(text: str) -> list[tuple[int, int, str]]:
    """start, end and header with its rule of the pipe tables that have one."""
    out = []
    for m in PIPE_BLOCK.finditer(text):
        rows = m[0].split("\n", 2)
        if len(rows) > 1 and is_rule(rows[1]):
            out.append((m.start(), m.end(), f"{rows[0]}\n{rows[1]}"))
    return out


def hard_split(text: str, cap: int) -> list[str]:
    """Pieces shorter than `cap`: each ends at the last blank line of its second half, else at its last line end, else at
    its last blank or tab, which go, else where it is full. A piece that goes on with the rows of a table whose header
    was in the one before has the header first, if that takes less than half a piece."""
    tables = headed_tables(text)
    out: list[str] = []
    at, head, owner = 0, "", -1  # owner: the table whose header the piece has
    while at < len(text):
        room = cap - 1 - len(head)
        if len(text) - at <= room:
            out.append(head + text[at:])
            break
        end = go_on = at + room
        for pattern, share in BREAKS:
            low = max(0 if head else 1, int(cap * share) - len(head))
            if m := pattern.match(text, at + low, at + room):
                end, go_on = m.span(1)
                break
        out.append(head + text[at:end])
        i = bisect_right(tables, (go_on,)) - 1
        inside = i >= 0 and tables[i][0] < go_on < tables[i][1] and PIPE.match(text, go_on)
        has_header = i == owner or i >= 0 and tables[i][0] >= at and end >= tables[i][0] + len(tables[i][2])
        head, owner = (f"{tables[i][2]}\n", i) if inside and has_header and len(tables[i][2]) < cap // 2 else ("", -1)
        at = go_on
    return out


def exploded(docs: DataFrame, f: Callable[[str], list[tuple | None]], schema: str, names: list[str], id_col: str = "doc_id", carry: Sequence[str] = (), then: Sequence[Step] = ()) -> DataFrame:
    """id, the carried columns, n and the fields of each tuple that f makes of a text; a text on which f fails gives one row
    with `error`. What f gives as None has a number and no row. Steps add their columns in the same worker."""
    kept = [id_col, *carry]
    own = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n int", schema, "error string"])
    fields = list(to_arrow_schema(StructType.fromDDL(own)))[len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, of: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(fields)
            left = [b.column(b.schema.get_field_index(c)).take(pa.array(of, pa.int64())) for c in kept]
            done = pa.record_batch([*left, *(pa.array(c, k.type) for c, k in zip(columns, fields, strict=True))], names=[*kept, *(k.name for k in fields)])
            return reduce(lambda x, step: step[1](x), then, done)

        for b in batches:
            of, out, size = [], [], 0
            for i, text in enumerate(b.column(b.schema.get_field_index("text"))):
                t = text.as_py() or ""
                try:
                    got = [(n, *x, None) for n, x in enumerate(f(t)) if x is not None]
                except Exception as e:  # a text that a hook can't take is reported, the others go on
                    got = [(None, *([None] * len(names)), f"{type(e).__name__}: {e}")]
                out += got
                of += [i] * len(got)
                size += len(t)
                if len(out) >= MANY or size >= LONG:
                    yield made(b, of, out)
                    of, out, size = [], [], 0
            yield made(b, of, out)

    return spread(docs.select(*kept, "text")).mapInArrow(run, ", ".join([own, *(ddl for ddl, _ in then)]))


def chunks(docs: DataFrame, cap: int = 24_000) -> DataFrame:
    """doc_id, n, text, error: texts under the cap."""
    return exploded(docs, lambda t: [(x,) for x in hard_split(t, cap)] if t.strip() else [], "text string", ["text"])


def placed_chunks(docs: DataFrame, cap: int = 24_000) -> DataFrame:
    """chunks() with chunk_start: where each begins in the text that joins a document's chunks with a blank line."""

    def f(t: str) -> list[tuple]:
        parts = hard_split(t, cap) if t.strip() else []
        return list(zip(parts, accumulate((len(x) + 2 for x in parts), initial=0)))  # noqa: B905

    return exploded(docs, f, "text string, chunk_start long", ["text", "chunk_start"])


def spans(chunk: DataFrame, least: int = 2, id_col: str = "chunk_id", of: Callable[[str], list[tuple[int, int, str]]] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """chunk_id, n, start, end, kind, text, error, by spans_of() or another segmenter, and the chunk's carried columns.
    Blank spans are dropped after numbering, so numbers may have gaps."""
    cut = of or (lambda t: spans_of(t, least))
    filled = lambda t: [(a, b, k, t[a:b]) if t[a:b].strip(BLANK) else None for a, b, k in cut(t)]
    return exploded(chunk, filled, "start int, end int, kind string, text string", ["start", "end", "kind", "text"], id_col, carry)


def check_tiling(span: DataFrame, chunk: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks whose spans don't follow one another from 0 to the text's end."""
    w = Window.partitionBy(id_col).orderBy("start")
    gap = F.coalesce(F.lag("end").over(w), F.lit(0)) != F.col("start")
    per = span.withColumn("_gap", gap).groupBy(id_col).agg(F.max(F.col("_gap").cast("int")).alias("gaps"), F.max("end").alias("upto"))
    return chunk.select(id_col, F.length("text").alias("size")).join(per, id_col, "left").where("coalesce(gaps, 0) = 1 or coalesce(upto, 0) != size").select(id_col)


def units(span: DataFrame, decided: Column | None = None, by: str = "doc_id") -> DataFrame:
    """Spans (doc_id, chunk_id, pos, kind, text) with `unit`: furniture and fragments go; a new unit begins at another
    chunk, a heading, title or table, where decided, and after a table's last row."""
    kept = span.where(~F.coalesce(F.col("kind").isin(*FURNITURE), F.lit(False)) & F.col("text").rlike(TWO_ALNUM))
    w = Window.partitionBy(by).orderBy("pos")
    k = kept.withColumn("_start", F.coalesce(F.col("kind").isin(*STARTS), F.lit(False)) | F.coalesce(F.lag("chunk_id").over(w) != F.col("chunk_id"), F.lit(True)) | (decided if decided is not None else F.lit(False)))
    k = k.withColumn("_start", F.col("_start") | (F.coalesce(F.lag("kind").over(w) == "table_row", F.lit(False)) & (F.coalesce(F.col("kind"), F.lit("")) != "table_row")))
    return k.withColumn("unit", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_start")


def unit_parts(kinds: list[str | None], texts: list[str], cap: int) -> list[str]:
    """Parts under the cap of a unit's spans in order; a table's later parts repeat its header."""
    texts = [t.strip() for t in texts]
    head = texts[0] if "table_row" in kinds else ""
    parts: list[list[str]] = [[]]
    size = -1  # of the last part's texts, joined
    for t in texts:
        carried = len(head) + 1 if head and len(parts) > 1 else 0
        if parts[-1] and carried + size + 1 + len(t) > cap:
            parts.append([])
            size = -1
        parts[-1].append(t)
        size += 1 + len(t)
    return ["\n".join(([head] if head and i else []) + p) for i, p in enumerate(parts)]


def units_of(spans: list[tuple[int, int, str, str]], cap: int) -> list[tuple[int, int, str]]:
    """unit, part, text of one chunk's spans: units() and capped_units() without a shuffle, since no unit leaves its chunk."""
    found: list[list[tuple[str, str]]] = []
    before = ""
    for _, _, kind, text in spans:
        if kind in FURNITURE or not TWO_ALNUM_HERE.search(text):
            continue
        if not found or kind in STARTS or before == "table_row" != kind:
            found.append([])
        found[-1].append((kind, text))
        before = kind
    return [(u, p, t) for u, x in enumerate(found) for p, t in enumerate(unit_parts(*map(list, zip(*x, strict=True)), cap))]


def spans_and_parts(chunk: DataFrame, cap: int = 6000, least: int = 2, carry: Sequence[str] = (), then: Sequence[Step] = ()) -> DataFrame:
    """chunk_id, n, start, end, kind, text of spans() and, as rows of their own with unit, part, text and no kind, the parts of
    the chunk's units, which count from 0 in each chunk; one pass over the texts."""

    def f(t: str) -> list[tuple | None]:
        cut = [(a, b, k, t[a:b]) for a, b, k in spans_of(t, least)]
        return [(*x, None, None) if x[3].strip(BLANK) else None for x in cut] + [(None, None, None, x, u, p) for u, p, x in units_of(cut, cap)]

    names = ["start", "end", "kind", "text", "unit", "part"]
    return exploded(chunk, f, "start int, end int, kind string, text string, unit long, part int", names, "chunk_id", carry, then)


def capped_units(unit: DataFrame, cap: int = 6000, by: str = "doc_id") -> DataFrame:
    """doc_id, unit, part, text: a unit's spans in parts under the cap; a table's later parts repeat its header. A fold
    over one unit's spans, which the chunk cap bounds."""
    kind = unit.schema[by].dataType.simpleString()
    whole = unit.groupBy(by, "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("s")).select(by, "unit", F.col("s")["kind"].alias("kinds"), F.col("s")["text"].alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [unit_parts(k.as_py(), t.as_py(), cap) for k, t in zip(b.column(2), b.column(3), strict=True)]
            of = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            yield pa.record_batch(
                [b.column(0).take(of), b.column(1).cast(pa.int64()).take(of), pa.array([i for p in parts for i in range(len(p))], pa.int32()), pa.array([t for p in parts for t in p], pa.string())],
                names=[by, "unit", "part", "text"],
            )

    return whole.mapInArrow(run, f"`{by}` {kind}, unit long, part int, text string")


def table_rows(tables: DataFrame) -> DataFrame:
    """doc_id, table_id, row, header, cells of tables (doc_id, table_id, grid array of rows): row 0 is the header, white
    space in cells is squashed."""
    clean = F.transform("grid", lambda r: F.transform(r, lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    t = tables.select("doc_id", "table_id", clean.alias("g"))
    return t.select("doc_id", "table_id", F.get("g", F.lit(0)).alias("header"), F.posexplode(F.slice("g", 2, 1_000_000)).alias("i", "cells")).select("doc_id", "table_id", (F.col("i") + 1).alias("row"), "header", "cells")


def table_markdown(rows: Column) -> Column:
    """A grid as a pipe table: pipes escaped, a rule after the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    all_ = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(all_, 1, 1), F.array(rule), F.slice(all_, 2, 1_000_000)), "\n")


def scan_quality(text: Column, blank: int = 10, garbled: float = 0.3, poor: float = 0.6) -> Column:
    """BLANK, UNREADABLE, DEGRADED or READABLE from a page's text: its length, then the share of tokens that are words."""
    tok = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    good = F.size(F.filter(tok, lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", "").rlike(r"^\p{L}{2,20}$|^[\p{N}.,]+$|^\p{L}$")))
    share = F.when(F.size(tok) > 0, good / F.size(tok)).otherwise(0.0)
    return F.when(F.length(F.btrim(F.coalesce(text, F.lit("")))) < blank, "BLANK").when(share < garbled, "UNREADABLE").when(share < poor, "DEGRADED").otherwise("READABLE")

