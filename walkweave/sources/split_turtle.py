"""Turtle and TriG read by byte ranges: many tasks share a large file.

Spark's text source cuts files into ranges of lines.  Only long strings reach over
line ends, so at the start of a line a reader is in one of three states.  A first
pass finds for each range the state at its end, given each state at its start, and
its prefix and base declarations; folded by file, in the order of the ranges, these
give each range its state and what is declared before it.  A second pass parses
the statements that lie within a range; what stands before the first end of a
statement and after the last one goes, as text, to be joined with its neighbours'.

A file whose lines are each a whole statement without prefixed names, as in N-Triples,
is parsed by Spark's own expressions.  A file in which a declaration does not stand on a line of its own is read whole
by one task, with the same rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from walkweave.spark import cut, stored

from .ntriples import unescape
from .rdf import read, turtle, turtle_tokens

#: A line that says the same wherever it stands between statements: whole addresses without escapes (and without what Python may take for white space), and strings without code points or the mark that parts them here.
_SAFE = r"[!#-;=?-\[\]_a-z~\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{2070}-\x{2fff}\x{3001}-\x{d7ff}\x{e000}-\x{fefe}\x{ff00}-\x{fffd}\x{10000}-\x{10ffff}]"
_WHOLE = rf"<([A-Za-z][A-Za-z0-9+.-]*:{_SAFE}*+)>"
_TEXT = rf'"([^"\\\x01]*+(?:\\[^uU\x01][^"\\\x01]*+)*+)"(?:@[A-Za-z]++(?:-[A-Za-z0-9]+)*+|\^\^<[A-Za-z][A-Za-z0-9+.-]*:{_SAFE}*+>)?'
ALONE = rf"^\s*{_WHOLE}\s*{_WHOLE}\s*(?:{_WHOLE}|{_TEXT})\s*\.\s*(?:#.*)?\z"
_NOTHING = r"^\s*(?:#.*)?\z"

#: The states: outside, or inside of a long string in double or single quotes.
OUT, DOUBLE, SINGLE = range(3)
_ENDS = {DOUBLE: re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.DOTALL), SINGLE: re.compile(r"(?:[^\\']|\\.|'(?!''))*'''", re.DOTALL)}
_SCAN = re.compile(
    r"""\#[^\n]*|<[^<>"{}|^`\\\s]*(?:\\u[0-9A-Fa-f]{4}[^<>\s]*)*>|(?P<open>\"\"\"|''')|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\#<"']+|.""",
    re.DOTALL,
)
_MAY_DECLARE = re.compile(r"@?(?:prefix|base)\b", re.IGNORECASE)
_DECLARES = re.compile(r"\s*(?:@(?P<a>prefix\s+[^\s:]*:|base)\s*<[^<>\s]*>\s*\.|(?i:(?P<b>prefix\s+[^\s:]*:|base))\s*<[^<>\s]*>)\s*(?:#.*)?$")


def after(line: str, state: int) -> int:
    """The state after a line."""
    if '"""' not in line and "'''" not in line:
        return state
    at = 0
    while at < len(line):
        if state != OUT:
            end = _ENDS[state].match(line, at)
            if not end:
                return state
            state, at = OUT, end.end()
            continue
        found = _SCAN.match(line, at)
        at = found.end()
        if found["open"]:
            state = DOUBLE if found["open"] == '"""' else SINGLE
    return state


def declared(line: str) -> str | None:
    """What a line declares (``base``, or ``prefix`` and its name), if that is all that it does."""
    found = _DECLARES.match(line)
    if not found:
        return None
    kind, *name = (found["a"] or found["b"]).split()
    return " ".join([kind.lower(), *name])


def _note(header: list[str], line: str) -> None:
    """Adds a declaration. It takes an older one's place, but where a base is declared, which what follows may rest on."""
    held = {declared(h): h for h in header}
    name = declared(line)
    if name in held and "base" not in held:
        header.remove(held[name])
    header.append(line.strip())


def _tokens(line: str) -> list[tuple[str, str]] | None:
    try:
        return turtle_tokens(line)
    except ValueError:
        return None


def _odd(line: str) -> bool:
    """Whether a line, from outside of strings, may declare something in a way that :func:`declared` doesn't see."""
    tokens = _tokens(line)
    # A line that ends within a long string has no tokens of its own.
    return tokens is None or any((k == "at" and v in ("@prefix", "@base")) or (k == "word" and v.lower() in ("prefix", "base")) for k, v in tokens)


def ends_statement(line: str) -> bool:
    """Whether a line, from outside of strings, ends with the end of a statement."""
    if "." not in line:
        return False
    tokens = _tokens(line)
    return bool(tokens) and tokens[-1] == ("sign", ".")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """A task's ranges: file, start, and the lines."""

    def lines():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    rows = lines()
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def own() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:2] == key:
                yield row[2]
                row = next(rows, None)

        found = own()
        yield *key, found
        for _ in found:  # whatever was not read
            pass


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and state at its start: the state at its end, its declarations, and whether one is odd."""
    for file, block, lines in _ranges(batches):
        states, held, odd = [OUT, DOUBLE, SINGLE], [[], [], []], [False] * 3
        for line in lines:
            if _MAY_DECLARE.search(line):
                name = declared(line)
                strange = name is None and _odd(line)
                for k in range(3):
                    if states[k] == OUT and name:
                        held[k].append(line.strip())
                    elif strange:  # also in a string that ends in this line
                        odd[k] = odd[k] or states[k] == OUT or after(line, states[k]) == OUT
            if '"""' in line or "'''" in line:
                states = [after(line, s) for s in states]
        rows = [[file] * 3, [block] * 3, [OUT, DOUBLE, SINGLE], states, held, odd]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TYPES)], names=["file", "block", "state", "end", "declared", "odd"])


_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_()]


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """A file's ranges in order: where the state or what is declared differs from the range before."""
    at = {(b, s): (e, d, o) for b, s, e, d, o in zip(rows["block"], rows["state"], rows["end"], rows["declared"], rows["odd"])}
    state, header, odd, before, out = OUT, [], False, None, []
    for block in sorted(set(rows["block"])):
        if (state, tuple(header)) != before:
            before = (state, tuple(header))
            out.append((int(block), state, "\n".join(header)))
        state, lines, strange = at[block, state]
        odd = odd or strange
        for line in lines:
            _note(header, line)
    file = rows["file"].iloc[0]
    return pd.DataFrame([(file, *r, odd) for r in out], columns=["file", "block", "state", "header", "odd"])


def _statements(file: str, block: int, lines: Iterator[str], state: int, header: list[str], base: str, piece: int):
    """A range's triples, and the texts before its first and after its last end of a statement."""
    header, number = list(header), 0
    own: list[str] = []
    starts: list[int] = []
    size, head = 0, True

    def parsed(n: int):
        nonlocal own, starts, size, number
        text = "\n".join([*header, *own[:n]])
        for line, s in zip(own[:n], starts):
            if s == OUT and _MAY_DECLARE.search(line) and declared(line):
                _note(header, line)
        made = [(*t, None, None, None) for t in turtle(text, base, f"t{block}x{number}x")]
        own, starts, size, number = own[n:], starts[n:], sum(map(len, own[n:])), number + 1
        return made

    for line in lines:
        own.append(line)
        starts.append(state)
        size += len(line) + 1
        began, state = state, after(line, state)
        if (head or size >= piece) and began == OUT and state == OUT and ends_statement(line):
            if head:
                yield [(None, None, None, 0, "\n".join(header), "\n".join(own))]
                for text, s in zip(own, starts):
                    if s == OUT and _MAY_DECLARE.search(text) and declared(text):
                        _note(header, text)
                own, starts, size, head = [], [], 0, False
            else:
                yield parsed(len(own))
    if head:  # not a single statement ends here
        yield [(None, None, None, 1, "\n".join(header), "\n".join(own))]
        return
    states = [*starts[1:], state]
    last = next((i + 1 for i in range(len(own) - 1, -1, -1) if starts[i] == states[i] == OUT and ends_statement(own[i])), 0)
    if last:
        yield parsed(last)
    yield [(None, None, None, 2, "\n".join(header), "\n".join(own))]


def _marked(triples, file: str) -> list[tuple]:
    return [tuple(f"{x}@{file}" if x is not None and x.startswith("_:") else x for x in t[:3]) for t in triples]


def read_turtle(spark: SparkSession, path: str, base: str = "", piece: int = 1 << 18) -> DataFrame:
    """``s, p, o`` of Turtle or TriG files, each read by as many tasks as Spark's text source cuts it into.

    The driver gets for each file what is declared in it; texts of about ``piece``
    characters are parsed at a time.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # Whether all lines of a file stand alone: a row for each file.
    kinds = cut(lines.groupBy("file").agg(F.bool_and(F.col("value").rlike(ALONE) | F.col("value").rlike(_NOTHING)).alias("alone")))
    alone, rest = (F.broadcast(kinds.where(c).select("file")) for c in ("alone", "NOT alone"))
    parts = F.split(F.regexp_replace("value", ALONE, "$1\u0001$2\u0001$3$4\u0001"), "\u0001")
    plain = lines.join(alone, "file", "left_semi").select(parts.alias("x")).where(F.size("x") > 1)
    plain = plain.select(*[unescape(F.col("x")[i]).alias(c) for i, c in enumerate("spo")])
    return plain if rest.isEmpty() else plain.unionByName(_read_ranges(spark, lines.join(rest, "file", "left_semi").select("file", "block", "value"), base, piece))


def _read_ranges(spark: SparkSession, lines: DataFrame, base: str, piece: int) -> DataFrame:
    """The triples of ``file, block, value``: lines as Spark's text source reads them, in its order."""
    found = lines.mapInArrow(_first, "file string, block bigint, state int, end int, declared array<string>, odd boolean")
    known: dict[str, list[tuple[int, int, str]]] = {}
    odd: set[str] = set()
    for r in found.groupBy("file").applyInPandas(_fold, "file string, block bigint, state int, header string, odd boolean").collect():
        known.setdefault(r.file, []).append((r.block, r.state, r.header))
        if r.odd:
            odd.add(r.file)
    for rows in known.values():
        rows.sort()
    shared = spark.sparkContext.broadcast((known, odd))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odd = shared.value
        for file, block, own in _ranges(batches):
            if file in odd:
                continue
            rows = known[file]
            _, state, header = rows[bisect_right(rows, block, key=lambda r: r[0]) - 1]
            for made in _statements(file, block, own, state, header.split("\n") if header else [], base or file, piece):
                marked = _marked(made, file)
                columns = [[file] * len(made), [block] * len(made), *([m[i] for m in marked] for i in range(3)), *([m[i] for m in made] for i in range(3, 6))]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.string(), pa.string()])], names=["file", "block", "s", "p", "o", "kind", "header", "text"])

    rows, _ = stored(lines.mapInArrow(parse, "file string, block bigint, s string, p string, o string, kind int, header string, text string"))
    # Before a range's first statement's end stands the end of what the last range with such an end left open.
    open_at = Window.partitionBy("file").orderBy("block", "kind")
    pieces = rows.where("kind IS NOT NULL").withColumn("seam", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(open_at))
    seams = pieces.groupBy("file", "seam").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "header", "text"))).alias("x"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, seam, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = "\n".join([parts[0]["header"], *(p["text"] for p in parts)])
                made = _marked(turtle(text, base or file, f"s{seam}x"), file)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=["s", "p", "o"])

    out = rows.where("kind IS NULL").select("s", "p", "o").unionByName(seams.select("file", "seam", "x").mapInArrow(join, "s string, p string, o string"))
    for file in sorted(odd):
        out = out.unionByName(read(spark, file, "turtle", base))
    return out
