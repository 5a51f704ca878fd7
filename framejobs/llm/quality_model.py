"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's score is one weighted sum of hashed features; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - score). All grades share the weights, so a rating teaches the whole scale. The
expected grade ranks documents, the tail probability P(grade >= k) selects them.

Features of a text: its lower-cased words, their first four and five letters, their shapes (letter case, digits, symbols), and
coarse counts of repetition; each counts by presence. Buckets that do not depart from chance in any grade are screened
out, and the score is divided by the root of the kept buckets, so long texts do not score louder than short ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 18
#: About this many rated documents of each grade train the model (a documented bound; drawn by hash of the id).
RATED_PER_GRADE = 3000
EDGES = re.compile(r"^\W+|\W+$")
_words: dict[str, tuple[int, ...]] = {}


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(word: str) -> str:
    out = []
    for c in word:
        s = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def word_features(word: str) -> tuple[int, ...]:
    known = _words.get(word)
    if known is None:
        if len(_words) >= 400_000:
            _words.clear()
        core = EDGES.sub("", word.lower())
        known = (_bucket("w", core), _bucket("5", core[:5]), _bucket("4", core[:4]), _bucket("s", _shape(word)))
        _words[word] = known
    return known


def features(text: str | None) -> np.ndarray:
    """Sorted buckets present in a text; empty for a text without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int32)
    counts = Counter(words)
    found: set[int] = set()
    for word in counts:
        found.update(word_features(word))
    n = len(words)
    found.add(_bucket("distinct", str(10 * len(counts) // n) if n >= 20 else "short"))
    found.add(_bucket("top", str(20 * max(counts.values()) // n) if n >= 20 else "short"))
    found.add(_bucket("stutter", str(min(5, 20 * sum(a == b for a, b in zip(words, words[1:])) // n))))
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class OrdinalModel:
    """Shared weights of the kept buckets (ascending) and ordered thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, index: np.ndarray) -> float:
        if not len(self.buckets):
            return 0.0
        at = np.minimum(np.searchsorted(self.buckets, index), len(self.buckets) - 1)
        hit = at[self.buckets[at] == index]
        return float(self.weights[hit].sum() / max(1, len(hit)) ** 0.5)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -500, 500)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tails(score).sum(axis=1)


def screen(columns: int, index: np.ndarray, owner: np.ndarray, grades: np.ndarray, least: float = 8.0, at_least: int = 300) -> np.ndarray:
    """Columns whose presence departs from chance in some grade by ``least`` standard deviations, or the
    ``at_least`` farthest where fewer do. The rest would only add noise to long texts."""
    n, seen = len(grades), np.bincount(index, minlength=columns)
    far = np.zeros(columns)
    for grade in np.unique(grades):
        own = grades == grade
        share = own.mean()
        hits = np.bincount(index, own[owner], minlength=columns)
        spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9))
        far = np.maximum(far, np.abs(hits - seen * share) / spread)
    far[seen < 3] = 0
    bar = min(least, np.partition(far, -at_least)[-at_least]) if columns > at_least else 0.0
    return np.flatnonzero((far >= bar) & (far > 0))


def fit(rows: list[np.ndarray], grades: np.ndarray, grade_count: int, rounds: int = 120, decay: float = 0.05, rate: float = 0.3) -> OrdinalModel:
    """Maximise the cumulative-link likelihood with L2 decay by full-batch Adam; thresholds stay ordered because
    their gaps are exponentials. ``grades`` are 0 ... grade_count - 1; a grade without ratings keeps a small gap."""
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    columns, index = np.unique(np.concatenate([*rows, np.zeros(0, dtype=np.int32)]), return_inverse=True)
    kept = screen(len(columns), index, owner, grades)
    place = np.full(len(columns), -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    use = place[index] >= 0
    owner, index, columns = owner[use], place[index[use]], columns[kept]
    sizes = np.bincount(owner, minlength=len(rows))
    value = 1 / np.sqrt(np.maximum(sizes, 1))[owner]
    n, width = len(rows), len(columns)
    shares = (np.array([(grades < k).sum() for k in range(1, grade_count)]) + 0.5) / (n + 1)
    start = np.log(shares / (1 - shares))
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, head, gap = params[:width], params[width], np.exp(params[width + 1:])
        theta = np.concatenate([[-np.inf], head + np.concatenate([[0], np.cumsum(gap)]), [np.inf]])
        score = np.bincount(owner, weights[index] * value, minlength=n)
        pu, pl = (1 / (1 + np.exp(-np.clip(theta[grades + k] - score, -500, 500))) for k in (1, 0))
        mass = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / mass / n, pl * (1 - pl) / mass / n
        pull = np.bincount(grades + 1, -du, minlength=grade_count + 1) + np.bincount(grades, dl, minlength=grade_count + 1)
        inner = pull[1:-1]
        grad = np.concatenate([
            np.bincount(index, (du - dl)[owner] * value, minlength=width) + decay * weights / n,
            [inner.sum()], [inner[k:].sum() * gap[k - 1] for k in range(1, len(inner))],
        ])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - rate * (1 - 0.9 * step / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return OrdinalModel(
        columns.astype(np.int32), params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1:]))]))


def rated_sample(docs: DataFrame, ratings: DataFrame, per_grade: int, id_col: str, text_col: str, grade_col: str) -> DataFrame:
    """About ``per_grade`` rated documents of each grade, those with the lowest hash of their id."""
    rated = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where(
        "doc_id is not null and grade is not null")
    counts = dict(rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per grade
    chance = F.lit(0.0)
    for grade, n in counts.items():
        chance = F.when(F.col("grade") == grade, F.lit(per_grade / n)).otherwise(chance)
    drawn = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < chance * (1 << 30))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id")  # at most about per_grade rows of each grade


def train(
    docs: DataFrame, ratings: DataFrame, grade_count: int, per_grade: int = RATED_PER_GRADE, id_col: str = "doc_id",
    text_col: str = "text", grade_col: str = "grade",
) -> OrdinalModel:
    """Fit on the bounded rated sample; its texts become buckets on the executors, only those reach the driver."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "buckets": [features(t).tobytes() for t in pdf["text"]]})

    sample = rated_sample(docs, ratings, per_grade, id_col, text_col, grade_col)
    rows = sorted((r.doc_id, r.grade, bytes(r.buckets)) for r in sample.mapInPandas(run, "doc_id long, grade int, buckets binary").collect())
    return fit([np.frombuffer(b, dtype=np.int32) for _, _, b in rows], np.array([g for _, g, _ in rows], dtype=np.int64), grade_count)


def rate(docs: DataFrame, model: OrdinalModel, grade: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``expected_grade``, ``tail_probability`` (of ``grade`` or more) and ``selected``.

    A text without words, null included, is not selected: grade 0, probability 0. Columns of those names in
    ``docs`` are replaced. Every row is rated on its whole text; ties and repeated rows rate alike.
    """
    columns = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "selected")]

    @F.pandas_udf("struct<expected_grade:double,tail_probability:double>")
    def rated(texts: pd.Series) -> pd.DataFrame:
        found = [features(t) for t in texts]
        tails = model.tails(np.array([model.score(f) for f in found])) * np.array([len(f) > 0 for f in found])[:, None]
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, grade - 1]})

    return docs.select(*columns, rated(F.col(text_col)).alias("__rated")).select(
        *columns, "__rated.*", (F.col("__rated.tail_probability") >= least).alias("selected"))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from two flags: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
