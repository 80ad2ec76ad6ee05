"""Toxicity by weak supervision.

Voters are terms (whole words, or beginnings of words) mined from labelled
texts, and patterns of writing.  A generative label model (each voter fires with
one probability in toxic and another in clean texts, estimated by expectation
maximisation together with the labels as one more, fallible voter) gives
posterior labels; voters that fire together beyond what the label explains are
modelled together.  A linear classifier is trained on the posterior labels and scores
every text.

The fit takes a bounded sample of labelled rows (``sample_rows``, those with the
smallest hashes of the id, equal texts once, with their highest label); everything
else covers all rows.  ``candidates`` and ``voters`` bound the terms that are tried
and taken.

Edge cases: a null or empty text, or one without any voter, gets the classifier's
base score; rows with a null label or id teach nothing, and an id with several
labels counts as its highest, as do equal texts of several ids; without toxic labels every score is the smoothed
base rate, below one half; extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, map_rows, texts

_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of writing, beside mostly capitals: runs of marks, stretched letters, letters behind signs, and shouted words.
_FORMS = {
    "#marks": re.compile(r"[!?]{2,}"),
    "#stretched": re.compile(r"([^\W\d_])\1{4}"),
    "#masked": re.compile(r"[^\W\d_][*#$%]+[^\W\d_]"),
    "#shouted": re.compile(r"\b[A-Z]{4,}!"),
}
_BEGINNINGS = (3, 4, 5, 6)
PATTERNS = ("#capitals", *_FORMS)


def terms_of(words: set[str]) -> set[str]:
    """The words, marked as whole, and their beginnings."""
    found = {f"{w}$" for w in words}
    for n in _BEGINNINGS:
        found |= {w[:n] for w in words if len(w) >= n}
    return found


def patterns_of(text: str) -> list[str]:
    """Which patterns of writing a text shows."""
    out = []
    upper = sum(map(str.isupper, text))
    if upper > 20 and 2 * upper > sum(map(str.isalpha, text)):
        out.append(PATTERNS[0])
    return out + [name for name, form in _FORMS.items() if form.search(text)]


class Finder:
    """Which of the given voters fire in a text."""

    def __init__(self, voters: list[str]):
        self.number = {v: i for i, v in enumerate(voters)}
        self.heads = {v[: min(_BEGINNINGS)] for v in voters if v[0] != "#"}
        self.short = {v[:-1] for v in voters if v.endswith("$") and len(v) <= min(_BEGINNINGS)}
        self.patterns = any(p in self.number for p in PATTERNS)

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        heads, short = self.heads, self.short
        words = {w for w in _WORD.findall(text.lower()) if w[:3] in heads or w in short}
        found = {self.number[t] for t in terms_of(words) if t in self.number} if words else set()
        if self.patterns:
            found |= {self.number[p] for p in patterns_of(text) if p in self.number}
        return sorted(found)


class LabelModel:
    """A generative model of voters: what they do given the label, and which of them act together.

    Voters whose residuals (what the label leaves unexplained) are correlated
    beyond ``linked`` make a group of up to ``most``; a group fires in patterns,
    each with one probability in toxic and another in clean texts.  All is
    estimated by expectation maximisation, the given labels being one more,
    fallible voter; groups are found once the first estimates stand.
    """

    def __init__(self, fires: np.ndarray, labels: np.ndarray, rounds: int = 60, linked: float = 0.3, most: int = 4):
        self.votes = np.column_stack((fires, labels)).astype(float)
        self.groups = [[i] for i in range(self.votes.shape[1])]
        posterior = np.where(labels > 0, 0.9, 0.1)
        for turn in range(rounds):
            before = posterior
            self.rate = (posterior.sum() + 1) / (len(posterior) + 2)
            self.on_toxic, self.on_clean = self._means(posterior), self._means(1 - posterior)
            if turn == 3:
                self.correlation = self._correlation(posterior)
                self.groups = self._grouped(linked, most)
            odds = np.log(self.rate / (1 - self.rate)) + self._evidence(posterior)
            posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if turn > 4 and np.abs(posterior - before).max() < 1e-6:
                break
        self.posterior = posterior
        #: A voter's part of its group's weight.
        self.share = np.array([1 / len(g) for v in range(self.votes.shape[1]) for g in self.groups if v in g])
        self.accuracy = (posterior @ self.votes + (1 - posterior) @ (1 - self.votes)) / len(self.votes)

    def _means(self, weight: np.ndarray) -> np.ndarray:
        return (weight @ self.votes + 0.5) / (weight.sum() + 1)

    def _evidence(self, posterior: np.ndarray) -> np.ndarray:
        """The log of how much likelier each row's patterns are in toxic than in clean texts."""
        total = np.zeros(len(self.votes))
        self.tables: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for group in self.groups:
            pattern = (self.votes[:, group] @ (1 << np.arange(len(group)))).astype(int)
            size = 1 << len(group)
            toxic, clean = ((np.bincount(pattern, w, size) + 0.5) / (w.sum() + 0.5 * size) for w in (posterior, 1 - posterior))
            self.tables.append((group, toxic, clean))
            total += np.log(toxic / clean)[pattern]
        return total

    def _correlation(self, posterior: np.ndarray) -> np.ndarray:
        """Correlations of voters given the label."""
        rest = self.votes - np.outer(posterior, self.on_toxic) - np.outer(1 - posterior, self.on_clean)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        return (rest.T @ rest) / len(rest) / np.outer(spread, spread)

    def _grouped(self, linked: float, most: int) -> list[list[int]]:
        """The most correlated voters first, as long as their group is small enough; the given labels stand alone."""
        n = self.votes.shape[1]
        group = {v: [v] for v in range(n)}
        pairs = np.argwhere(np.triu(np.abs(self.correlation[: n - 1, : n - 1]) > linked, 1))
        for a, b in sorted(pairs.tolist(), key=lambda p: (-abs(self.correlation[p[0], p[1]]), p)):
            if group[a] is not group[b] and len(group[a]) + len(group[b]) <= most:
                merged = sorted(group[a] + group[b])
                for v in merged:
                    group[v] = merged
        return [g for v, g in group.items() if v == g[0]]


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 0.02, rounds: int = 100) -> np.ndarray:
    """Weights (the last for the constant) of a logistic regression on soft labels, by damped Newton steps."""
    x = np.column_stack((x, np.ones(len(x)))).astype(float)
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (target - p) - ridge * weights
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


class Classifier:
    """Voters with the weights of the linear classifier."""

    def __init__(self, voters: list[str], weights: np.ndarray):
        self.voters, self.weights, self.find = voters, [float(w) for w in weights], Finder(voters)

    def score(self, text: str | None) -> float:
        total = self.weights[-1] + sum(self.weights[i] for i in self.find(text))
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, total)))))


def _choose(rows: list[tuple[int, list[int]]], terms: list[str], most: int, chance: float = 5e-7) -> list[int]:
    """Terms that together cover the toxic texts, each chosen for the texts that no earlier one of its round has.

    A term counts only if so large a part of its texts would be toxic by chance
    less often than ``chance`` (by Chernoff's bound), which allows for the many
    terms tried; clean texts that hold it count against it by the share of toxic ones.
    Of terms that begin with one another only one is taken.  A second round
    covers the texts again by other terms, as long as these add as many.
    """
    n = len(terms)
    toxic = [set(f) for y, f in rows if y]
    base = min(0.9, len(toxic) / max(1, len(rows)))
    enough = max(3.0, np.log(chance) / np.log(base))
    wrong = np.zeros(n)
    for y, f in rows:
        if not y:
            wrong[f] += 1
    holders: list[list[int]] = [[] for _ in range(n)]
    for i, f in enumerate(toxic):
        for t in f:
            holders[t].append(i)
    right = np.array([len(h) for h in holders], float)
    bare = [t.rstrip("$") for t in terms]
    part = right / np.maximum(right + wrong, 1)
    surprise = right * np.log(np.maximum(part, 1e-9) / base) + wrong * np.log(np.maximum(1 - part, 1e-9) / (1 - base))
    free = (right >= 3) & (part > base) & (surprise >= -np.log(chance))
    chosen: list[int] = []
    for price, least in ((15, 2), (15, enough), (5, 2), (5, enough)):  # nearly pure terms first, then weaker ones
        worth = right - price * base / (1 - base) * wrong
        usable = free & (worth > 0)
        gain = np.where(usable, worth, -1)
        covered = np.zeros(len(toxic), bool)
        while n and len(chosen) < most and gain.max() >= least:
            best = int(gain.argmax())
            chosen.append(best)
            for i in holders[best]:
                if not covered[i]:
                    covered[i] = True
                    for t in toxic[i]:
                        gain[t] -= 1
            kin = [i for i in range(n) if bare[i].startswith(bare[best]) or bare[best].startswith(bare[i])]
            free[kin] = False
            gain[kin] = -1
    return chosen


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning, by its id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, candidates: int = 5_000, voters: int = 400) -> Classifier:
    """The classifier, from a sample of at most ``sample_rows`` labelled rows outside the held-out part."""
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so many rows of two numbers may be broadcast
    sample = texts(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(marked), "doc_id")
    sample = checkpointed(sample.groupBy("text").agg(F.max("y").alias("y")))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows():
            found = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "clean": pa.array([counts[0][t] for t in found], pa.int64()), "toxic": pa.array([counts[1][t] for t in found], pa.int64())})
            counts[0].clear(), counts[1].clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update(terms_of(set(_WORD.findall(text.lower()))))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from rows()
        yield from rows()

    mined = sample.mapInArrow(mine, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    price = 5 * counted.get(1, 0) / max(1, counted.get(0, 0))  # a clean text weighs less the more of them there are
    mined = mined.where((F.col("toxic") >= 3) & (F.col("toxic") > price * F.col("clean"))).orderBy(F.desc(F.col("toxic") - price * F.col("clean")), F.desc(F.length("term")), "term").limit(candidates)
    # Of equally good terms the longest, most specific one comes first.
    terms = [r[0] for r in mined.collect()]
    find = Finder([*terms, *PATTERNS])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "fires": pa.array([find(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))})

    rows = sorted((r[0], list(r[1])) for r in sample.mapInArrow(votes, "y int, fires array<int>").collect())
    labels_of = np.array([y for y, _ in rows], float)
    if not labels_of.any():
        rate = 1 / (len(rows) + 3)
        return Classifier([], np.array([np.log(rate / (1 - rate))]))
    places = _choose([(y, [t for t in f if t < len(terms)]) for y, f in rows], terms, voters)
    places += range(len(terms), len(terms) + len(PATTERNS))
    column = {t: i for i, t in enumerate(places)}
    fires = np.zeros((len(rows), len(places)))
    for i, (_, f) in enumerate(rows):
        fires[i, [column[t] for t in f if t in column]] = 1
    model = LabelModel(fires, labels_of)
    return Classifier([[*terms, *PATTERNS][t] for t in places], logistic(fires, model.posterior))


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's toxicity: ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        def step(batch: pa.RecordBatch):
            scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield [batch.column(0).to_pylist(), batch.column(2).to_pylist(), scores, [int(s >= 0.5) for s in scores]]

        return step

    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    return map_rows(texts(docs, id_col, text_col, held_out(id_col).alias("held_out")), fields, make)
