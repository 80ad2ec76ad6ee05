"""Token counts of pair-merging piece vocabularies with byte fallback, by prefix dynamic programming.

Every prefix of a text has one valid last piece: the piece that makes a
*compatible* pair with the last piece of the prefix that it leaves (the two
pieces' characters, encoded together, give the two pieces again).  So the exact
token count of every prefix is the count of that shorter prefix plus the last
piece's tokens, and it is stored: the count at any place, and the longest prefix
that keeps within a budget, are looked up and nothing is encoded again.

A text is cut where no piece of the vocabulary reaches over (before a space mark
that follows something else, and between characters that are never neighbours in
a piece, as letters and digits); the prefixes of what lies between the cuts are
one table for a worker, shared by all texts.

Edge cases: a null or empty text has no tokens; a text of any length is counted
whole; repeated rows give repeated rows; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

SPACE = "▁"
_NEVER = 1 << 60


def read_pieces(path: str) -> dict[str, int]:
    """The pieces of a SentencePiece model and their merging order (equal scores have equal places).

    Models whose texts are changed before encoding (but for spaces, which become
    marks), and those with unused, user-defined or without byte pieces, are
    refused: prefixes of their texts are not what is encoded.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
    if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or not plain:
        raise ValueError("the model must merge pairs and leave texts as they are, with a space mark in front")
    if any(p.type not in known for p in model.pieces) or sum(p.type == kinds.BYTE for p in model.pieces) != 256:
        raise ValueError("the model must have all byte pieces, and none that are unused or user-defined")
    normal = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    place = {score: i for i, score in enumerate(sorted(set(normal.values()), reverse=True))}
    return {piece: place[score] for piece, score in normal.items()}


def _words(order: dict[str, int]) -> str:
    """A pattern whose matches are parts of a text that no piece reaches over.

    Space marks go with what follows them, and characters go together if they are
    neighbours in some piece, directly or through others. Where a piece holds a
    mark after another character, the whole text is one part.
    """
    group: dict[str, str] = {}

    def find(c: str) -> str:
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    for piece in order:
        for a, b in zip(piece, piece[1:]):
            if b == SPACE != a:
                return ".+"
            if a != SPACE:
                group[find(a)] = find(b)
    runs: dict[str, list[str]] = {}
    for c in sorted(group):
        runs.setdefault(find(c), []).append(re.escape(c))
    classes = [f"[{''.join(run)}]+" for run in sorted(runs.values(), key=len, reverse=True)]
    return f"{SPACE}*(?:{'|'.join([*classes, f'[^{SPACE}]'])})|{SPACE}+"


class Pieces:
    """A vocabulary, and which pairs of its pieces are compatible. Single characters are pieces, known or not."""

    def __init__(self, order: dict[str, int], keep: int = 1_000_000):
        self.order, self.keep = order, keep
        self.longest = max(map(len, order), default=1)
        self._sizes: dict[str, set[int]] = {}
        for piece in order:
            self._sizes.setdefault(piece[-4:], set()).add(len(piece))
        self.ordered: dict[str, list[int]] = {}
        self._edges: dict[tuple[str, bool], list[tuple[str, int]] | None] = {}
        self._whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = re.compile(_words(order), re.DOTALL)

    def tokens(self, piece: str) -> int:
        """A piece's tokens: one, or a character's bytes where the vocabulary lacks it."""
        return 1 if piece in self.order else len(piece.encode())

    def merge(self, parts: list[str], stop: int = 1) -> tuple[list[str], list[int]]:
        """Merges the pair that comes first, leftmost of equals, until none is left or ``stop`` parts are; and the places of the merges."""
        parts, done = list(parts), []
        while len(parts) > stop:
            place, i = min((self.order.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if place == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            done.append(place)
        return parts, done

    def is_whole(self, piece: str) -> bool:
        """Whether the piece's characters are merged to this piece."""
        if piece not in self._whole:
            self._whole[piece] = len(self.merge(list(piece))[0]) == 1
        return self._whole[piece]

    def edge(self, piece: str, right: bool) -> list[tuple[str, int]] | None:
        """The parts that stand at one end of a piece as it is merged, each with the place of the merge that ends it.

        None where a merge comes before one that it rests on: then the parts don't follow each other in the order of places.
        """
        key = (piece, right)
        if key not in self._edges:
            up, node, falling = [(piece, _NEVER)], piece, True
            while len(node) > 1:
                ends = self.order[node]
                falling = falling and ends <= up[-1][1]
                parts, done = self.merge(list(node), 2)
                falling = falling and all(p <= ends for p in done)
                node = parts[-1 if right else 0]
                up.append((node, ends))
            self._edges[key] = up[::-1] if falling else None
        return self._edges[key]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the characters of two pieces, encoded together, give the two pieces."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self._fits(left, right)
            if len(self.pairs) >= self.keep:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _fits(self, left: str, right: str) -> bool:
        if not (self.is_whole(left) and self.is_whole(right)):
            return False
        a, b = self.edge(left, True), self.edge(right, False)
        if a is None or b is None:
            return self.merge(list(left + right))[0] == [left, right]
        i = j = 0
        while True:
            (x, end_x), (y, end_y) = a[i], b[j]
            place = self.order.get(x + y, _NEVER)
            # A merge over the seam stands left of those that end the right part and right of those that end the left one.
            if place != _NEVER and place < end_x and place <= end_y:
                return False
            if end_x == end_y == _NEVER:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1

    def sizes(self, ending: str) -> list[int]:
        """The possible sizes, longest first, of a piece at the end of what ends in these (up to four) characters."""
        found = self.ordered.get(ending)
        if found is None:
            shorter = {n for n in (2, 3) if ending[-n:] in self.order}
            found = self.ordered[ending] = sorted(self._sizes.get(ending, set()) | shorter | {1}, reverse=True)
        return found

    def last(self, prefix: str, before: Callable[[int], str]) -> str:
        """The one valid last piece of a prefix; ``before(i)`` has that of its first i characters."""
        end = len(prefix)
        for n in self.sizes(prefix[-4:]):
            if n <= end:
                piece = prefix[end - n :]
                if (n == 1 or piece in self.order) and (self.compatible(before(end - n), piece) if n < end else self.is_whole(piece)):
                    return piece
        raise AssertionError("every prefix has a last piece")


class PrefixTable:
    """The last pieces and the token counts of all prefixes of a string; entry 0 is that of the empty one."""

    def __init__(self, pieces: Pieces, text: str = ""):
        self.pieces, self.text, self.last, self.counts = pieces, "", [""], [0]
        self.append(text)

    def append(self, more: str) -> None:
        start, self.text = len(self.text), self.text + more
        for end in range(start + 1, len(self.text) + 1):
            piece = self.pieces.last(self.text[max(0, end - self.pieces.longest) : end], self._before(end))
            self.last.append(piece)
            self.counts.append(self.counts[end - len(piece)] + self.pieces.tokens(piece))

    def _before(self, end: int) -> Callable[[int], str]:
        skipped = max(0, end - self.pieces.longest)
        return lambda i: self.last[skipped + i]


class Counter:
    """Counts texts. The tables of words up to 64 characters are one, keyed by prefix; ``keep`` bounds it (a full one is dropped)."""

    def __init__(self, pieces: Pieces, keep: int = 800_000):
        self.pieces, self.keep = pieces, keep
        self._known: dict[str, tuple[str, int]] = {}

    def words(self, text: str | None) -> list[str]:
        """The text as it is encoded, with a mark in front and for spaces, in parts that no piece reaches over."""
        return self.pieces.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _add(self, word: str) -> int:
        """The word's count, with what is missing of its prefixes put into the table."""
        if len(word) > 64:
            return PrefixTable(self.pieces, word).counts[-1]
        known, pieces = self._known, self.pieces
        if len(known) >= self.keep:
            known.clear()
        order, pairs, sizes = pieces.order, pieces.pairs, pieces.ordered
        start = len(word) - 1
        while start and word[:start] not in known:
            start -= 1
        # As Pieces.last, without its calls.
        for end in range(start + 1, len(word) + 1):
            prefix = word[:end]
            ending = prefix[-4:]
            for n in sizes.get(ending) or pieces.sizes(ending):
                if n < end:
                    piece = prefix[end - n :]
                    known_piece = piece in order
                    if known_piece or n == 1:
                        last, count = known[prefix[: end - n]]
                        fits = pairs.get((last, piece))
                        if fits is None:
                            fits = pieces.compatible(last, piece)
                        if fits:
                            known[prefix] = (piece, count + (1 if known_piece else pieces.tokens(piece)))
                            break
                elif n == end and (n == 1 or prefix in order) and pieces.is_whole(prefix):
                    known[prefix] = (prefix, pieces.tokens(prefix))
                    break
        return known[word][1]

    def prefixes(self, word: str) -> list[int]:
        """The token counts of a word's prefixes, from the empty one on."""
        if len(word) > 64:
            return PrefixTable(self.pieces, word).counts
        if word not in self._known:
            self._add(word)
        return [0, *(self._known[word[:i]][1] for i in range(1, len(word) + 1))]

    def totals(self, words: list[str]) -> list[int]:
        get, add = self._known.get, self._add
        return [entry[1] if (entry := get(word)) else add(word) for word in words]

    def count(self, text: str | None) -> int:
        return sum(self.totals(self.words(text)))

    def counts(self, text: str | None) -> list[int]:
        """The token counts of all prefixes of a text; entry i is that of its first i characters."""
        out, base = [0], 0
        for k, word in enumerate(self.words(text)):
            made = self.prefixes(word)
            # The first character that is encoded is the mark in front.
            out += [base + c for c in made[1 if k else 2 :]]
            base += made[-1]
        return out

    def measure(self, text: str | None, limit: int) -> tuple[int, int]:
        """The tokens of a text, and the number of characters of its longest prefix with no more than ``limit`` of them."""
        words = self.words(text)
        totals = self.totals(words)
        every = sum(totals)
        if every <= limit:
            return every, len(text or "")
        starts = np.cumsum([0, *totals[:-1]])
        # Prefixes that end in a word have more tokens than the words before it: the last one that starts below the limit decides.
        at = int(np.searchsorted(starts, limit)) - 1
        if at < 0:
            return every, 0
        left = limit - int(starts[at])
        within = max(j for j, c in enumerate(self.prefixes(words[at])) if c <= left)
        return every, max(0, sum(map(len, words[:at])) + within - 1)


_COUNTERS: dict[tuple, Counter] = {}


def _counter(key: tuple, order: dict[str, int]) -> Counter:
    """The counter of this worker process, made at its first task and reused by the next ones."""
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(Pieces(order))
    return _COUNTERS[key]


def _shared(docs: DataFrame, path: str):
    """What makes a task's counter: the driver reads the model, whose pieces (a fixed size) are broadcast."""
    order = read_pieces(path)
    held, key = docs.sparkSession.sparkContext.broadcast(order), (path, len(order), hash(tuple(order.items())))
    return lambda: _counter(key, held.value)


def count(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id, n_bytes, n_tokens, over_limit`` and ``n_kept``, the characters of its longest prefix of at most ``limit`` tokens."""
    counter = _shared(docs, path)

    def make():
        measure = counter().measure

        def step(batch: pa.RecordBatch):
            found = [measure(t, limit) for t in batch.column(1).to_pylist()]
            tokens = [n for n, _ in found]
            yield [batch.column(0), batch.column(2), tokens, [n > limit for n in tokens], [k for _, k in found]]

        return step

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_kept", pa.int64())]
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes")
    return map_rows(texts(docs, id_col, text_col, n_bytes), fields, make)


def truncate(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id, text, n_tokens``: the longest prefix of its text with at most ``limit`` tokens (null stays null)."""
    counter = _shared(docs, path)

    def make():
        task = counter()

        def step(batch: pa.RecordBatch):
            whole = batch.column(1).to_pylist()
            kept = [None if t is None else t[: task.measure(t, limit)[1]] for t in whole]
            yield [batch.column(0), kept, [task.count(t) for t in kept]]

        return step

    return map_rows(texts(docs, id_col, text_col), [("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64())], make)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id, counts``: the token count of every prefix, from the empty one on.

    A table to be written: ``at_place`` and ``longest_within`` answer from it
    with built-in functions, for any place or budget.
    """
    counter = _shared(docs, path)

    def make():
        task = counter()

        def step(batch: pa.RecordBatch):
            # Lists are made a row at a time, as a long text's are as long as it is.
            made = [np.asarray(task.counts(t), np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(made), np.int32, int(ends[-1]))))]

        return step

    return map_rows(texts(docs, id_col, text_col), [("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))], make)


def at_place(counts: Column, place: Column) -> Column:
    """The token count of the first ``place`` characters (of all, where there are fewer)."""
    return F.element_at(counts, (F.greatest(F.lit(0), F.least(place, F.size(counts) - 1)) + 1).cast("int"))


def longest_within(counts: Column, budget: Column) -> Column:
    """The characters of the longest prefix whose tokens keep within a budget (none where that is below zero)."""
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.coalesce(F.array_max(fits), F.lit(0))
