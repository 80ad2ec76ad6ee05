"""RDF/XML, Turtle (and TriG's default graph) and JSON-LD, as a Python data source: ``spark.read.format("rdf")``.

These formats can't be split, so each file is one task's; large graphs belong
into N-Triples.  Files are listed and read through Spark (``binaryFile``), so
any store that it reads will do; parsing is plain Python.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Triple = tuple[str, str, str]
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_XML = "{http://www.w3.org/XML/1998/namespace}"


def _resolve(base: str, reference: str) -> str:
    """The reference seen from the base; whole addresses and a trailing ``#`` stay as they are."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", reference):
        return reference
    whole = urljoin(base, reference)
    return whole + "#" if reference.endswith("#") and not whole.endswith("#") else whole


def rdf_xml(data: bytes, base: str = "") -> Iterator[Triple]:
    """The triples of an RDF/XML document: node and property elements, property attributes, collections, parse types."""
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(element, at: str) -> Iterator:
        at = element.get(f"{_XML}base", at)
        own = {name(k): v for k, v in element.attrib.items() if not k.startswith(_XML)}
        if f"{RDF}about" in own:
            subject = _resolve(at, own.pop(f"{RDF}about"))
        elif f"{RDF}ID" in own:
            subject = _resolve(at, "#" + own.pop(f"{RDF}ID"))
        elif f"{RDF}nodeID" in own:
            subject = "_:" + own.pop(f"{RDF}nodeID")
        else:
            subject = fresh()
        yield subject
        if name(element.tag) != f"{RDF}Description":
            yield subject, f"{RDF}type", name(element.tag)
        for k, v in own.items():
            yield subject, k, _resolve(at, v) if k == f"{RDF}type" else v
        members = 0
        for child in element:
            predicate = name(child.tag)
            if predicate == f"{RDF}li":
                members += 1
                predicate = f"{RDF}_{members}"
            yield from prop(subject, predicate, child, at)

    def nested(element, at: str):
        found = node(element, at)
        return next(found), found

    def prop(subject: str, predicate: str, child, at: str) -> Iterator[Triple]:
        at = child.get(f"{_XML}base", at)
        own = {name(k): v for k, v in child.attrib.items() if not k.startswith(_XML)}
        kind = own.pop(f"{RDF}parseType", None)
        own.pop(f"{RDF}datatype", None)
        own.pop(f"{RDF}ID", None)
        if kind == "Literal":
            yield subject, predicate, (child.text or "") + "".join(ET.tostring(x, "unicode") for x in child)
        elif kind == "Resource":
            inner = fresh()
            yield subject, predicate, inner
            for x in child:
                yield from prop(inner, name(x.tag), x, at)
        elif kind == "Collection":
            head = f"{RDF}nil"
            cells = []
            for x in child:
                cells.append((fresh(), *nested(x, at)))
            yield subject, predicate, cells[0][0] if cells else head
            for i, (cell, item, rest) in enumerate(cells):
                yield cell, f"{RDF}first", item
                yield cell, f"{RDF}rest", cells[i + 1][0] if i + 1 < len(cells) else head
                yield from rest
        elif f"{RDF}resource" in own or f"{RDF}nodeID" in own or (own and not len(child)):
            if f"{RDF}resource" in own:
                obj = _resolve(at, own.pop(f"{RDF}resource"))
            else:
                obj = "_:" + own.pop(f"{RDF}nodeID") if f"{RDF}nodeID" in own else fresh()
            yield subject, predicate, obj
            for k, v in own.items():
                yield obj, k, v
        elif len(child):
            item, rest = nested(child[0], at)
            yield subject, predicate, item
            yield from rest
        else:
            yield subject, predicate, child.text or ""

    root = ET.parse(io.BytesIO(data)).getroot()
    at = root.get(f"{_XML}base", base)
    for element in root if name(root.tag) == f"{RDF}RDF" else [root]:
        found = node(element, at)
        next(found)
        yield from found


_TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*(?:\\u[0-9A-Fa-f]{4}[^<>\s]*)*>)
    |(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w·-]+(?:\.+[\w·-]+)*)
    |(?P<name>(?:[^\W\d_][\w·-]*(?:\.+[\w·-]+)*)?:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w:·.-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,\[\](){}])""",
    re.VERBOSE | re.DOTALL,
)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text, flags=re.DOTALL)


def turtle_tokens(text: str) -> list[tuple[str, str]]:
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"Turtle: unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
    return tokens


def turtle(text: str, base: str = "", named: str = "t") -> Iterator[Triple]:
    """The triples of a Turtle document; the graphs of TriG are read into one. Blank nodes without a name get ``named`` and a number."""
    tokens = turtle_tokens(text)
    prefixes: dict[str, str] = {}
    found: list[Triple] = []
    place = blanks = 0

    def peek(ahead: int = 0) -> tuple[str, str]:
        return tokens[place + ahead] if place + ahead < len(tokens) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal place
        token = peek()
        if token[0] == "end" or (value is not None and token[1] != value):
            raise ValueError(f"Turtle: expected {value or 'more'}, got {token[1] or 'the end'!r}")
        place += 1
        return token

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:{named}{blanks}"

    def iri(kind: str, value: str) -> str:
        if kind == "iri":
            return _resolve(base, _unescaped(value[1:-1]))
        prefix, _, local = value.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"Turtle: unknown prefix {prefix!r}")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term() -> str:
        kind, value = take()
        if kind in ("iri", "name"):
            return iri(kind, value)
        if kind == "blank":
            return value
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            if peek()[0] == "at":
                take()
            elif peek()[0] == "type":
                take()
                term()
            return _unescaped(value[cut:-cut])
        if kind == "number" or kind == "word" and value in ("true", "false"):
            return value
        if value == "[":
            node = fresh()
            if peek()[1] != "]":
                properties(node)
            take("]")
            return node
        if value == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            cells = [fresh() for _ in items] + [f"{RDF}nil"]
            for cell, item, after in zip(cells, items, cells[1:]):
                found.extend([(cell, f"{RDF}first", item), (cell, f"{RDF}rest", after)])
            return cells[0]
        raise ValueError(f"Turtle: unexpected {value!r}")

    def properties(subject: str) -> None:
        while True:
            if peek() == ("word", "a"):
                take()
                predicate = f"{RDF}type"
            else:
                predicate = term()
            while True:
                found.append((subject, predicate, term()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]", "}", ""):
                return

    while peek()[0] != "end":
        kind, value = peek()
        word = value.lstrip("@").lower()
        if (kind == "at" and value in ("@prefix", "@base")) or (kind == "word" and word in ("prefix", "base")):
            take()
            if word == "prefix":
                prefix = take()[1][:-1]
                prefixes[prefix] = iri(*take())
            else:
                base = iri(*take())
            if kind == "at":
                take(".")
            continue
        if kind == "word" and word == "graph":
            take()
            continue
        if value in ("{", "}"):
            take()
            continue
        only = value == "["
        subject = term()
        if peek()[1] == "{":  # a graph's name
            continue
        if not (only and peek()[1] == "."):
            properties(subject)
        if peek()[1] == ".":
            take()
    yield from found


def json_ld(data: bytes, base: str = "") -> Iterator[Triple]:
    """The triples of a JSON-LD document with inline contexts (prefixes, terms, ``@vocab``, ``@id`` and ``@list``)."""
    blanks = 0

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:j{blanks}"

    def merged(context: dict, more) -> dict:
        for part in more if isinstance(more, list) else [more]:
            if isinstance(part, str):
                raise ValueError("JSON-LD: contexts elsewhere are not fetched")
            context = {} if part is None else context | part
        return context

    def full(name: str, context: dict, vocab: bool) -> str:
        seen = set()
        while vocab and name in context and name not in seen:
            seen.add(name)
            found = context[name]
            name = found.get("@id", name) if isinstance(found, dict) else found
        head, colon, tail = name.partition(":")
        if colon and not tail.startswith("//") and head in context:
            return full(head, context, True) + tail
        if colon or name.startswith("@"):
            return name
        return context.get("@vocab", "") + name if vocab else _resolve(context.get("@base", base), name)

    def text(value) -> str:
        return str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else json.dumps(value)

    def node(item: dict, context: dict):
        context = merged(context, item["@context"]) if "@context" in item else context
        aliases = {k: v for k, v in context.items() if isinstance(v, str) and v.startswith("@")}
        item = {aliases.get(k, k): v for k, v in item.items()}
        subject = full(item["@id"], context, False) if "@id" in item else fresh()
        yield subject
        for key, value in item.items():
            if key == "@type":
                for kind in value if isinstance(value, list) else [value]:
                    yield subject, f"{RDF}type", full(kind, context, True)
            elif key == "@graph":
                yield from graph(value, context)
            elif not key.startswith("@"):
                predicate = full(key, context, True)
                if ":" not in predicate:
                    continue
                made = context.get(key)
                for one in value if isinstance(value, list) else [value]:
                    yield from edge(subject, predicate, one, context, made if isinstance(made, dict) else {})

    def edge(subject: str, predicate: str, value, context: dict, made: dict):
        if value is None:
            return
        if isinstance(value, dict) and "@list" in value:
            items = value["@list"]
            cells = [fresh() for _ in items] + [f"{RDF}nil"]
            yield subject, predicate, cells[0]
            for cell, item, after in zip(cells, items, cells[1:]):
                yield from edge(cell, f"{RDF}first", item, context, made)
                yield cell, f"{RDF}rest", after
        elif isinstance(value, dict) and "@value" in value:
            yield subject, predicate, text(value["@value"])
        elif isinstance(value, dict):
            found = node(value, context)
            yield subject, predicate, next(found)
            yield from found
        else:
            yield subject, predicate, full(value, context, made["@type"] == "@vocab") if made.get("@type") in ("@id", "@vocab") else text(value)

    def graph(value, context: dict):
        for item in value if isinstance(value, list) else [value]:
            found = node(item, context)
            next(found)
            yield from found

    yield from graph(json.loads(data), {})


PARSERS = {"xml": rdf_xml, "turtle": lambda data, base="": turtle(data.decode(), base), "json-ld": json_ld}
#: Formats by the ends of file names.
ENDINGS = {".rdf": "xml", ".owl": "xml", ".xml": "xml", ".ttl": "turtle", ".trig": "turtle", ".n3": "turtle", ".jsonld": "json-ld", ".json": "json-ld", ".nt": "nt", ".nq": "nt"}


def format_of(path: str) -> str:
    for ending, kind in ENDINGS.items():
        if path.lower().rstrip("/").endswith(ending):
            return kind
    raise ValueError(f"can't tell the format of {path}")


def parse(data: bytes, kind: str, base: str = "") -> Iterator[Triple]:
    return (tuple(t) for t in PARSERS[kind](data, base))


def read(spark: SparkSession, path: str, kind: str, base: str = "") -> DataFrame:
    """``s, p, o`` of the files at a path, each read by one task; blank nodes are told apart by file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [tuple(f"{x}@{name}" if x.startswith("_:") else x for x in t) for t in parse(data, kind, base or name)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["s", "p", "o"])

    return files.mapInArrow(run, "s string, p string, o string")


class RdfDataSource(DataSource):
    """``spark.read.format("rdf").option("kind", ...).load(path)`` for files on a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema) -> DataSourceReader:
        return _RdfReader(self.options)


class _RdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("kind") or format_of(self.path)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[Triple]:
        with open(partition.value, "rb") as file:
            yield from parse(file.read(), self.kind, partition.value)
