"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can stand last in
the prefix's encoding.  It is the one whose predecessor (the last token of the
prefix that it leaves) makes a *compatible* pair with it: encoding the two
tokens' bytes together gives the same two tokens again.  So an encoding is a
table of last tokens; appending bytes only adds to the table, and after an edit
the table is computed anew only until it agrees with the old one for as many
positions as the longest token has bytes.

Edge cases: a null or empty text has no tokens (and the digests of nothing); a
text of any length is encoded whole; repeated rows give repeated rows; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, sha, texts

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and ranks, one pair a line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Vocabulary:
    """Ranks, the merge tree of every token, and which pairs of tokens are compatible."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.lengths = sorted({len(t) for t in ranks}, reverse=True)
        self.longest = self.lengths[0] if self.lengths else 0
        # The lengths, longest first, of the tokens that end in certain three bytes (or are shorter and end so).
        self._endings: dict[bytes, set[int]] = {}
        for token in ranks:
            self._endings.setdefault(token[-3:], set()).add(len(token))
        self._ordered: dict[bytes, list[int]] = {}
        self._spine: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._whole: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging of the lowest rank, leftmost first, down to ``stop`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            found = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if found[0] == _NEVER:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this token."""
        if token not in self._whole:
            self._whole[token] = len(self.merge(self.bytes_of[token])) == 1
        return self._whole[token]

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts on one edge of the token's merge tree, from the single byte up, each with the rank that ends it."""
        key = (token, right)
        if key not in self._spine:
            up, node = [(self.bytes_of[token], _NEVER)], self.bytes_of[token]
            while len(node) > 1:
                ends = self.ranks[node]
                node = self.merge(node, 2)[-1 if right else 0]
                up.append((node, ends))
            self._spine[key] = up[::-1]
        return self._spine[key]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the seam of two tokens comes before the merges that make them.

        The parts at the seam change as each side merges; a merge across it
        happens if its rank is below the next one on the left side and not
        above the next one on the right side (of equal ranks the left one goes
        first).
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            a, b = self.spine(left, True), self.spine(right, False)
            i = j = 0
            known = True
            while True:
                (x, end_x), (y, end_y) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < end_x and rank <= end_y:
                    known = False
                    break
                if end_x == end_y == _NEVER:
                    break
                if end_x <= end_y:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= 4_000_000:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def sizes(self, ending: bytes) -> list[int]:
        """The possible sizes of a token at the end of what ends in these (up to three) bytes."""
        found = self._ordered.get(ending)
        if found is None:
            shorter = {n for n in (1, 2) if ending[-n:] in self.ranks and n <= len(ending)}
            found = self._ordered[ending] = sorted(self._endings.get(ending, set()) | shorter, reverse=True)
        return found

    def last_token(self, data: bytes, end: int, last: Callable[[int], int]) -> int:
        """The unique valid last token of ``data[:end]``; ``last(i)`` has that of each shorter prefix."""
        ranks = self.ranks
        for n in self.sizes(data[max(0, end - 3) : end]):
            if n > end:
                continue
            token = ranks.get(data[end - n : end])
            if token is not None and (self.compatible(last(end - n), token) if n < end else self.is_whole(token)):
                return token
        raise ValueError(f"the vocabulary lacks the byte {data[end - 1]}")


class PrefixTable:
    """The last tokens of all prefixes of a byte string: exact appends, and edits that re-encode only what they change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(self.last, len(self.data))

    def _extend(self, last: list[int], to: int) -> None:
        for end in range(len(last), to + 1):
            last.append(self.vocabulary.last_token(self.data, end, last.__getitem__))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for ``data[start:end]``; returns how many positions were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        last, agree, done = old[: start + 1], 0, 0
        for at in range(start + 1, len(self.data) + 1):
            last.append(self.vocabulary.last_token(self.data, at, last.__getitem__))
            done += 1
            # An old entry holds on once all entries that later ones can look at are the old ones.
            agree = agree + 1 if at - len(new) > start and old[at - shift] == last[at] else 0
            if agree >= self.vocabulary.longest:
                last += old[at - shift + 1 :]
                break
        self.last = last
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; pieces share the table entries of their common prefixes.

    ``keep`` bounds the entries held (of pieces, and of prefixes); a full table
    is dropped and filled anew, which costs time only.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, keep: int = 400_000):
        self.vocabulary, self.pieces, self.keep = vocabulary, regex.compile(pattern), keep
        self._last: dict[bytes, int] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        if len(data) > 48:
            return tuple(PrefixTable(self.vocabulary, data).tokens())
        table, v = self._last, self.vocabulary
        ranks, compatible, sizes = v.ranks, v.compatible, v.sizes
        if len(table) > self.keep:
            table.clear()
        start = len(data)
        while start and data[:start] not in table:
            start -= 1
        for end in range(start + 1, len(data) + 1):
            prefix = data[:end]
            for n in sizes(prefix[-3:]):
                if n > end:
                    continue
                token = ranks.get(prefix[end - n :])
                if token is not None and (compatible(table[prefix[: end - n]], token) if n < end else v.is_whole(token)):
                    table[prefix] = token
                    break
            else:
                raise ValueError(f"the vocabulary lacks the byte {data[end - 1]}")
        out, end = [], len(data)
        while end:
            token = table.get(data[:end])
            if token is None:  # a part of the table was dropped since
                return tuple(PrefixTable(v, data).tokens())
            out.append(token)
            end -= len(v.bytes_of[token])
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, found = self._known, self.pieces.findall(text)
        for piece in found:
            if piece not in known:
                if len(known) > self.keep:
                    known.clear()
                    return self._plainly(found)
                known[piece] = self.piece(piece.encode())
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def _plainly(self, found: Iterable[str]) -> list[int]:
        return [token for piece in found for token in self.piece(piece.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def shared_encoder(key: str, ranks: Callable[[], dict[bytes, int]], pattern: str) -> Encoder:
    """The encoder of this worker process, made at its first task and reused by the next ones."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(ranks()), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each row's tokens: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids``.

    The driver reads the vocabulary file; its ranks (a fixed size) go to the
    executors as a broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = f"{path}\n{pattern}"

    def make():
        encoder = shared_encoder(key, lambda: ranks.value, pattern)
        text_of = encoder.vocabulary.text_of.__getitem__

        def step(batch: pa.RecordBatch):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0).to_pylist(),
                [len(x) for x in ids],
                [sha(" ".join(map(text_of, x)).encode()) for x in ids],
                [sha(encoder.decode(x)) for x in ids],
            ]
            yield [*columns, ids] if with_ids else columns

        return step

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return map_rows(texts(docs, id_col, text_col), fields + [("ids", pa.list_(pa.int32()))] * with_ids, make)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's token ids: ``doc_id, data``. A null list gives null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = f"{path}\n{pattern}"

    def make():
        encoder = shared_encoder(key, lambda: ranks.value, pattern)

        def step(batch: pa.RecordBatch):
            yield [batch.column(0).to_pylist(), [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]]

        return step

    return map_rows(encoded.select(id_col, ids_col), [("doc_id", pa.int64()), ("data", pa.binary())], make)
