"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans.

Learning counts hashed character n-grams of words (word ends marked) for each
language, and in which languages each script occurs, over all training rows;
what comes to the driver has a fixed size for each language.  A word's score for
a language is the mean, over n-gram lengths, of its n-grams' log-probabilities;
languages that do not write the word's script are no candidates for it.  Of all
ways to label a text's words the best one is taken, where each change of
language costs ``penalty``.  The language with most letters is the text's, and
the score is the share of letters in its spans.

Edge cases: a null text and one without letters are ``und`` with score 0; rows
with a null language or id teach nothing; a tie goes to the language first in
order; with nothing to learn from, every text is ``und``; texts of any length
are read whole; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep_rows, map_rows, texts

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_SIZES = (2, 3, 4)

#: First code points of script ranges and the scripts' names (fixed values, in order of the code points).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF_RANGE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def find_words(text: str) -> list[str]:
    """The runs of letters of a text."""
    words = _WORD.findall(text)
    if text.isascii():
        return words
    # Numbers that are no digits count as word characters to the pattern.
    return [w for w in ("".join(filter(str.isalpha, x)) if not x.isalpha() else x for x in words) if w]


def _grams(words: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of the n-grams of all words, and the words they are in."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = codes == 32
    word = np.cumsum(gap) - 1  # a gap belongs to the word after it
    with np.errstate(over="ignore"):
        for n in _SIZES:
            if len(codes) < n:
                continue
            count = len(codes) - n + 1
            h = np.full(count, n, np.uint64)
            inner = np.zeros(count, bool)
            for k in range(n):
                h = (h ^ codes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    inner |= gap[k : k + count]
            good = ~inner & ~(gap[:count] & gap[n - 1 :])
            yield (h[good] >> np.uint64(64 - bits)).astype(np.int64), word[:count][good]


def _scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, first, "right") - 1]


class Model:
    """What was learned: for each language, n-gram log-probabilities and the scripts it writes."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, bits: int, penalty: float = 8.0, rare: float = 0.001):
        self.languages, self.bits, self.penalty = languages, bits, penalty
        smooth = counts + 0.1
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = (share >= rare).T  # script by language
        self.writes[~self.writes.any(axis=1)] = True

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; languages that are no candidates get a prohibitive one."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 50_000):
            part = [w.lower() for w in words[at : at + 50_000]]
            total = np.zeros((len(part), len(self.languages)))
            for buckets, word in _grams(part, self.bits):
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(word, self.table[buckets, k], len(part))[: len(part)]
            total /= len(_SIZES)
            total[~self.writes[_scripts(part)]] = -1e6
            out[at : at + len(part)] = total
        return out - out.max(axis=1, keepdims=True, initial=-np.inf) if len(words) else out

    def label(self, sequences: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """The best labelling of each sequence of word numbers, all sequences advancing together."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        longest, k = (int(lengths[0]) if len(order) else 0), len(self.languages)
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
        offsets = np.concatenate(([0], np.cumsum(active)))
        flat = np.empty(offsets[-1], np.int64)
        for rank, i in enumerate(order):
            flat[offsets[: len(sequences[i])] + rank] = sequences[i]
        switched = np.empty((offsets[-1], k), bool)
        source = np.empty(offsets[-1], np.int8 if k < 128 else np.int32)
        state = np.zeros((len(order), k), np.float32)
        last = np.zeros(len(order), source.dtype)
        for t in range(longest):
            n, at = active[t], offsets[t]
            now = state[:n]
            best = now.argmax(axis=1)
            top = now[np.arange(n), best][:, None]
            now -= top  # only differences matter, and stay small
            switch = now < -self.penalty
            switched[at : at + n], source[at : at + n] = switch, best
            np.maximum(now, -self.penalty, out=now)
            now += scores[flat[at : at + n]]
            if t + 1 == longest or active[t + 1] < n:
                ends = slice(active[t + 1] if t + 1 < longest else 0, n)
                last[ends] = state[ends].argmax(axis=1)
        labels = np.empty(offsets[-1], source.dtype)
        for t in range(longest - 1, -1, -1):
            n, at = active[t], offsets[t]
            labels[at : at + n] = last[:n]
            last[:n] = np.where(switched[np.arange(at, at + n), last[:n]], source[at : at + n], last[:n])
        out: list = [None] * len(sequences)
        for rank, i in enumerate(order):
            out[i] = labels[offsets[: len(sequences[i])] + rank]
        return out

    def predict(self, batch: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(batch)
        numbers: dict[str, int] = {}
        sequences = []
        for text in batch:
            words = find_words(text) if text else []
            sequences.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        words = list(numbers)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        out = []
        for sequence, labels in zip(sequences, self.label(sequences, self.word_scores(words))):
            if len(sequence):
                of = np.bincount(labels, letters[sequence], len(self.languages))
                out.append((self.languages[int(of.argmax())], float(of.max() / of.sum())))
            else:
                out.append((UNDETERMINED, 0.0))
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """The text's spans of one language each: language, start and end in code points."""
        found = [m for m in _WORD.finditer(text or "") if any(map(str.isalpha, m[0]))]
        if not found or not self.languages:
            return []
        words = ["".join(filter(str.isalpha, m[0])) for m in found]
        out: list[tuple[str, int, int]] = []
        for m, k in zip(found, self.label([np.arange(len(words))], self.word_scores(words))[0]):
            if out and out[-1][0] == self.languages[k]:
                out[-1] = (out[-1][0], out[-1][1], m.end())
            else:
                out.append((self.languages[k], m.start(), m.end()))
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 15, penalty: float = 8.0) -> Model:
    """A model of all rows of ``docs`` with a language.

    Each task holds ``2 ** bits`` counts a language and emits their non-zero
    ones once; Spark sums them, so that the driver gets that many rows a
    language at most.
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def fold() -> None:
            for lang, counter in words.items():
                total = totals.setdefault(lang, np.zeros(size + len(_NAMES), np.int64))
                found = list(counter)
                weights = np.fromiter(counter.values(), np.int64, len(counter))
                for buckets, word in _grams([w.lower() for w in found], bits):
                    known = word < len(found)
                    total[:size] += np.bincount(buckets[known], weights[word[known]], size).astype(np.int64)
                total[size:] += np.bincount(_scripts(found), weights, len(_NAMES)).astype(np.int64)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(find_words(text or ""))
                if sum(map(len, words.values())) > 200_000:
                    fold()
        fold()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(languages), size + len(_NAMES)))
    counts[np.searchsorted(languages, counted["lang"].to_numpy(str)), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(languages, counts[:, :size], counts[:, size:], bits, penalty)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning, by its id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    return learn(docs.where(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull()), text_col, lang_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Each text's language: ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or _learned(docs, id_col, text_col, lang_col))

    def make():
        def step(batch: pa.RecordBatch):
            found = shared.value.predict(batch.column(1).to_pylist())
            yield [batch.column(0).to_pylist(), batch.column(2).to_pylist(), [x for x, _ in found], [y for _, y in found]]

        return step

    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    return map_rows(texts(docs, id_col, text_col, held_out(id_col).alias("held_out")), fields, make)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.4) -> DataFrame:
    """The documents with a language whose spans hold at least a share ``least`` of the letters, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(_learned(docs, id_col, text_col, lang_col))
    place = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> list[bool]:
            return [lang != UNDETERMINED and score >= least for lang, score in shared.value.predict(batch.column(place).to_pylist())]

        return step

    return keep_rows(docs, make)
