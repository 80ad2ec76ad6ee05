"""Secret scans: patterns find candidates, and structure confirms what decoding shows to be a key or a signed token.

Base kinds (patterns alone): ``assign`` (a value assigned to a name such as
password), ``access`` (an access key id) and ``hex`` (a long hexadecimal run).
Confirmed kinds: ``pem`` (an armoured private key), ``der`` (a bare private key
in base64 or hexadecimal), ``ssh`` (the same in OpenSSH's format) and ``jwt``
(a signed token).  A candidate of those is decoded, and only nested lengths that
fit exactly, known key layouts and readable token headers let it be reported.
Tokens without a signature are not, nor bare keys in lines of which the first has
under 20 characters.

Edge cases: a null or empty text has no spans; texts of any length are scanned
whole; repeated rows give repeated rows; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_rows, sha, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: A line about an encrypted body, by the old format's names.
ENCRYPTED = re.compile(r"^DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*([0-9A-Fa-f]{16,64})[ \t]*$", re.MULTILINE)
#: Possessive and from a run's first character on, so that a run is read once.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
HEADER = re.compile(r"^|e[w-z0-9_-]|[CDI]")
#: Where a key may begin: a sequence in base64 or hexadecimal, or OpenSSH's mark.
START = re.compile(r"(?<![0-9A-Fa-f])30(?::[0-9A-Fa-f]{2}){12}|M[A-I](?=[A-Za-z0-9+/_-]{18})|30[0-8](?=[0-9A-Fa-f]{37})|b3BlbnNzaC1rZXktdjEA")
BASE64_LINE, HEX_LINE = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: Bytes in hexadecimal, colons between them, over line ends.
COLON_PAIRS = re.compile(r"[0-9A-Fa-f]{2}(?::\s*[0-9A-Fa-f]{2})*")
#: An end of line, or one written with backslashes.
BREAK = re.compile(r"[ \t]*(?:[\r\n]|\\+[rn])(?:[ \t\r\n]|\\+[rn])*")

PADDING, PAIR = re.compile("={0,2}"), re.compile(r"[0-9A-Fa-f]{2}")
URL_SAFE = str.maketrans("-_", "+/")
JSON_START = re.compile(rb"\s*\{")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")

#: Bytes of candidate runs stay, all others become spaces.
_RUNS = bytes(c if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" and c < 128 else 32 for c in range(256))
_NAMES = (b"passw", b"secret", b"token", b"api")

Span = tuple[str, int, int]


def from_base64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Reader:
    """Bytes of an encoding, of which only those that are asked for are decoded."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.size, self.read = size, read

    def number(self, at: int, n: int) -> int | None:
        got = self.read(at, n) if at + n <= self.size else b""
        return int.from_bytes(got, "big") if len(got) == n else None


def of_bytes(data: bytes) -> Reader:
    return Reader(len(data), lambda at, n: data[at : at + n])


INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30

#: No key's layout has a sequence of more elements.
MOST_ELEMENTS = 10

Element = tuple[int, int, int]


def element_at(data: Reader, at: int, end: int) -> Element | None:
    """Tag, start and end of the contents of the definite-length element at this place; None if there is none before ``end``."""
    head = data.read(at, min(6, end - at))
    if len(head) < 2 or head[0] & 0x1F == 0x1F:
        return None
    size, more = head[1], 0
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or len(head) < 2 + more or not head[2]:
            return None
        size = int.from_bytes(head[2 : 2 + more], "big")
        if size < 0x80:
            return None
    at += 2 + more
    return (head[0], at, at + size) if at + size <= end else None


def elements(data: Reader, at: int, end: int) -> list[Element] | None:
    """The elements that fill a stretch exactly; None if they don't, or are more than any key has."""
    out: list[Element] = []
    while at < end:
        found = element_at(data, at, end) if len(out) < MOST_ELEMENTS else None
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def is_key_sequence(data: Reader, start: int, end: int) -> bool:
    """Whether a sequence's contents are laid out as a private key's; reads some headers of elements and nothing else."""
    first = element_at(data, start, end)
    if not first or not (first[0] == SEQUENCE or first[0] == INTEGER and first[2] - first[1] == 1):
        return False  # no layout begins otherwise
    inner = elements(data, start, end)
    if not inner:
        return False
    tags, sizes = [t for t, _, _ in inner], [b - a for _, a, b in inner]

    def algorithm(k: int) -> bool:
        parts = elements(data, *inner[k][1:])
        return bool(parts) and parts[0][0] == OBJECT_ID

    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and sizes[0] == 1:  # an algorithm and the key in it
        return algorithm(1) and sizes[2] > 0
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER} and sizes[0] == 1 and sizes[1] >= 32:  # version, modulus, exponents, primes
        return True
    version = data.number(inner[0][1], 1)
    if len(tags) == 6 and set(tags) == {INTEGER} and version == 0 and sizes[1] >= 32:
        return True
    if tags[:2] == [INTEGER, OCTETS] and version == 1 and sizes[1] >= 16:  # a curve's key
        return all(t in (0xA0, 0xA1) and bool(elements(data, a, b)) for t, a, b in inner[2:])
    if tags == [SEQUENCE, OCTETS] and sizes[1] >= 16:  # an encrypted key
        return algorithm(0)
    return False


def key_size(data: Reader) -> int | None:
    """Bytes of the private key that ``data`` begins with, by layout and nested lengths; None if there is none."""
    top = element_at(data, 0, data.size)
    return top[2] if top and top[0] == SEQUENCE and is_key_sequence(data, *top[1:]) else None


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key's encoding, to the end."""
    return key_size(of_bytes(data)) == len(data) > 0


SSH_MARK = b"openssh-key-v1\0"


def ssh_size(data: Reader) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with, by its mark and length-prefixed fields; None if there is none."""
    if data.size < len(SSH_MARK) or data.read(0, len(SSH_MARK)) != SSH_MARK:
        return None
    at = len(SSH_MARK)

    def field(least: int) -> bool:
        nonlocal at
        size = data.number(at, 4)
        if size is None or size < least or at + 4 + size > data.size:
            return False
        at += 4 + size
        return True

    if not (field(0) and field(0) and field(0)):
        return None
    keys = data.number(at, 4)
    at += 4
    return at if keys and keys <= 16 and all(field(1) for _ in range(keys)) and field(1) else None


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key, to the end."""
    size = ssh_size(of_bytes(data))
    return size is not None and not data[size:].strip(b"\0")


def _object(data: bytes | None) -> dict | None:
    """The JSON object that the bytes are; None if they are none."""
    try:
        found = json.loads(data or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def tokens(text: str) -> list[Span]:
    """Spans of signed tokens: a header that names an algorithm, claims and a signature of 16 bytes or more.

    They are three parts between dots, the header from any place of the first
    on.  A token without a signature has nothing that confirms it and is not
    reported.
    """
    out = []
    for m in DOTTED.finditer(text):
        parts, at, end = m[0].split("."), m.start(), 0
        for head, claims, signature in zip(parts, parts[1:], parts[2:]):
            if at >= end and len(from_base64(signature) or b"") >= 16 and _object(from_base64(claims)) is not None:
                # All starts at the same distance to the end, modulo four, lie in one decoding.
                decoded = [b"" if k == 1 else from_base64(head[(len(head) - k) % 4 :]) or b"" for k in range(4)]
                for s in HEADER.finditer(head):
                    size = len(head) - s.start()
                    data = decoded[size % 4]
                    begin = len(data) - size * 3 // 4
                    if size % 4 == 1 or not JSON_START.match(data, begin):
                        continue
                    if isinstance((_object(data[begin:]) or {}).get("alg"), str):
                        end = at + len(head) + len(claims) + len(signature) + 2
                        out.append(("jwt", at + s.start(), end))
                        break
            at += len(head) + 1
    return out


class Run:
    """Digits that belong together over line ends, without what is between them, and the places that they come from."""

    def __init__(self, pieces: Iterable[tuple[int, str]]):
        got: list[str] = []
        self.offsets, self.places, self.end, size = [], [], 0, 0
        for place, piece in pieces:
            self.offsets.append(size)
            self.places.append(place)
            got.append(piece)
            size += len(piece)
            self.end = place + len(piece)
        self.body = "".join(got)

    def offset(self, place: int) -> int:
        k = bisect_right(self.places, place) - 1
        return self.offsets[k] + place - self.places[k]

    def place(self, offset: int) -> int:
        k = bisect_right(self.offsets, offset) - 1
        return self.places[k] + offset - self.offsets[k]


def _lines(text: str, at: int, line: re.Pattern) -> Iterator[tuple[int, str]]:
    """Consecutive lines from ``at`` on, with their places."""
    while m := line.match(text, at):
        yield at, m[0]
        if not (gap := BREAK.match(text, m.end())):
            break
        at = gap.end()


def _pairs(text: str, at: int) -> Iterator[tuple[int, str]]:
    """Bytes between colons, with their places."""
    end = COLON_PAIRS.match(text, at).end()
    return ((m.start(), m[0]) for m in PAIR.finditer(text, at, end))


class KeyFinder:
    """Finds the keys of one text that begin at given places, in ascending order.

    A run is put together once for all places in it, and a place costs some
    headers of elements, so hostile texts take time in proportion as well.
    """

    def __init__(self, text: str):
        self.text = text
        self.runs: dict[str, Run] = {}

    def run(self, kind: str, at: int) -> Run:
        found = self.runs.get(kind)
        if found is None or at >= found.end:
            pieces = _pairs(self.text, at) if kind == "colons" else _lines(self.text, at, HEX_LINE if kind == "hex" else BASE64_LINE)
            found = self.runs[kind] = Run(pieces)
            if kind == "base64":
                found.body = found.body.translate(URL_SAFE)
        return found

    def key_at(self, at: int) -> Span | None:
        """The private key that begins at this place, in one line or several."""
        text = self.text
        first = text[at]
        kind = "colons" if text[at + 2 : at + 3] == ":" else "hex" if first == "3" else "base64"
        run = self.run(kind, at)
        start = run.offset(at)
        left = len(run.body) - start

        def of_base64(a: int, n: int) -> bytes:
            chunk = run.body[start + a // 3 * 4 : start + -(-(a + n) // 3) * 4]
            chunk = chunk[: len(chunk) - (len(chunk) % 4 == 1)]
            return binascii.a2b_base64(chunk + "=" * (-len(chunk) % 4))[a % 3 : a % 3 + n]

        def of_hex(a: int, n: int) -> bytes:
            return bytes.fromhex(run.body[start + 2 * a : start + 2 * (a + n)])

        data = Reader(left * 3 // 4, of_base64) if kind == "base64" else Reader(left // 2, of_hex)
        size = ssh_size(data) if first == "b" else key_size(data)
        if size is None:
            return None
        digits = -(-size * 4 // 3) if kind == "base64" else 2 * size
        end = run.place(start + digits - 1) + 1
        if kind == "base64":
            end += len(PADDING.match(text, end)[0])
        return "ssh" if first == "b" else "der", at, end


def armoured(text: str) -> list[tuple[int, int]]:
    """Spans of armoured private keys, from the last opening line before each closing one of its kind."""
    out, opened = [], None
    for m in PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2]:
            body = re.sub(r"\\+[rn]", "\n", text[opened.end() : m.start()]).replace("\\/", "/")
            sealed = ENCRYPTED.search(body)
            data = from_base64(re.sub(r"\s+", "", re.sub(r"^[A-Za-z-]+:.*$", "", body, flags=re.MULTILINE)))
            # An encrypted body is whole blocks of its cipher; the line about it gives one block.
            blocks = bool(sealed) and bool(data) and len(data) >= 64 and len(data) % 8 == 0
            if data and (blocks or is_private_key(data) or is_ssh_key(data)):
                out.append((opened.start(), m.end()))
            opened = None
    return out


def confirmed(text: str) -> list[Span]:
    """Spans of keys and tokens that decoding confirms."""
    out = [("pem", a, b) for a, b in armoured(text)]
    keys = iter([*out, ("pem", len(text), len(text))])
    armour = next(keys)
    out += tokens(text)
    end, finder = 0, KeyFinder(text)
    for m in START.finditer(text):
        while armour[2] <= m.start() < len(text):
            armour = next(keys)
        if m.start() < end or m.start() >= armour[1]:
            continue
        if found := finder.key_at(m.start()):
            out.append(found)
            end = found[2]
    return out


def base(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and without overlap for each kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def by_place(found: list[Span]) -> list[Span]:
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str | None, data: bytes | None = None) -> list[Span]:
    """All spans of a text by place; ``data``: its UTF-8 bytes, if at hand.

    Two cheap tests on the bytes let most texts go at once: no base pattern of
    names matches without one of the names, and all else has a long run.
    """
    if not text:
        return []
    data = text.encode() if data is None else data
    low = data.lower()
    out = []
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"-----BEGIN " in data or b"eyJ" in data or b"30:" in data or max(map(len, data.translate(_RUNS).split()), default=0) >= 20:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        out += confirmed(text)
    return by_place(out)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's secrets: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed``.

    Spans are in code points, the end exclusive.
    """

    def make():
        def step(batch: pa.RecordBatch):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            found = [scan(t, b) for t, b in zip(batch.column(1).to_pylist(), raw)]
            first = [[s for s in x if s[0] in BASE_KINDS] for x in found]
            counts = [[sum(s[0] == kind for s in x) for x in first] for kind in BASE_KINDS]
            yield [
                batch.column(0).to_pylist(),
                *counts,
                [sha(joined(x).encode()) for x in first],
                [joined(x) for x in found],
                [len(x) - len(y) for x, y in zip(found, first)],
            ]

        return step

    fields = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())]
    return map_rows(texts(docs, id_col, text_col), fields, make)


def mask(text: str, found: list[Span], sign: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``sign``."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b in found:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], sign]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with the secrets of the text column masked."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            raw = batch.column(place).cast(pa.binary()).to_pylist()
            new = [t if not (found := scan(t, b)) else mask(t, found) for t, b in zip(batch.column(place).to_pylist(), raw)]
            columns = [pa.array(new, type=pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
