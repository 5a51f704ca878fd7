"""Quality rules: counts of whole texts, and a line sequence labelling of content and boilerplate.

Every text is a sequence of lines; a linear-chain conditional random field with two labels, content and boilerplate,
scores each line by what it looks like and each step by the pair of labels. Viterbi decoding gives the best labelling;
the share of words on content lines decides retention.

The field is trained here by maximum likelihood on a bounded sample of rated documents: lines of good documents are
taken as content, lines of bad ones as boilerplate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framejobs.llm.quality_model import rated_sample

SYMBOLS = re.compile(r"[#*$%&|<>]")
NOTICE = re.compile(r"licen[sc]e|copyright|rights reserved|\ball rights\b|cookie|subscribe|click here|terms of", re.I)
LETTER = re.compile(r"[^\W\d_]")
WORD_WINDOW = 5
CONTENT, BOILERPLATE = 0, 1
#: About this many rated documents of each grade train the field (a documented bound; drawn by hash of the id).
RATED_PER_GRADE = 600


def _levels(name: str, value: float, bounds: tuple[float, ...]) -> str:
    return f"{name}{sum(value >= b for b in bounds)}"


FEATURES = [
    "bias", "blank", "first", "repeated", "notice", "ends",
    *[f"words{i}" for i in range(5)], *[f"symbols{i}" for i in range(4)], *[f"upper{i}" for i in range(4)],
    *[f"distinct{i}" for i in range(4)], *[f"length{i}" for i in range(4)], *[f"digits{i}" for i in range(3)],
    *[f"marks{i}" for i in range(3)],
]
PLACE = {name: i for i, name in enumerate(FEATURES)}


def line_features(lines: list[str]) -> list[tuple[int, ...]]:
    """Active features of each line."""
    seen: set[str] = set()
    found = []
    for number, line in enumerate(lines):
        words = line.split()
        if not words:
            found.append((PLACE["bias"], PLACE["blank"]))
            continue
        size, n = sum(map(len, words)), len(words)
        upper = sum(map(str.isupper, words))
        digits = sum(map(str.isdigit, words))
        names = [
            "bias", _levels("words", n, (3, 8, 20, 60)), _levels("symbols", len(SYMBOLS.findall(line)) / n, (0.02, 0.2, 0.6)),
            _levels("upper", upper / n, (0.1, 0.4, 0.8)), _levels("distinct", len(set(words)) / n, (0.1, 0.3, 0.5)),
            _levels("length", size / n, (2.5, 4, 9)), _levels("digits", digits / n, (0.05, 0.3)),
            _levels("marks", line.count("!") / n, (0.1, 0.5)),
        ]
        if number == 0:
            names.append("first")
        if line in seen:
            names.append("repeated")
        if NOTICE.search(line):
            names.append("notice")
        if line.rstrip()[-1] in ".?!\"')":
            names.append("ends")
        seen.add(line)
        found.append(tuple(PLACE[x] for x in names))
    return found


@dataclass
class Field:
    """Line weights (features x labels) and step weights (label before x label)."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, found: list[tuple[int, ...]]) -> list[int]:
        """The best labelling; ties go to content."""
        emit = self.emit.tolist()
        (cc, cb), (bc, bb) = self.step.tolist()
        back = []
        content = boiler = None
        for active in found:
            c = b = 0.0
            for f in active:
                w = emit[f]
                c += w[0]
                b += w[1]
            if content is None:
                content, boiler = c, b
                continue
            from_c, from_b = content + cc, boiler + bc
            to_c = from_c >= from_b
            c += from_c if to_c else from_b
            from_c, from_b = content + cb, boiler + bb
            to_b = from_c >= from_b
            b += from_c if to_b else from_b
            back.append((CONTENT if to_c else BOILERPLATE, CONTENT if to_b else BOILERPLATE))
            content, boiler = c, b
        if content is None:
            return []
        labels = [CONTENT if content >= boiler else BOILERPLATE]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _batch_gradient(emit, step, x, y, mask):
    """Log-likelihood gradient of one padded batch: x (docs, lines, features), y and mask (docs, lines)."""
    scores = x @ emit
    docs, lines, _ = scores.shape
    alpha = np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, lines):
        new = _lse(alpha[:, t - 1, :, None] + step[None], 1) + scores[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    total = _lse(alpha[:, -1], 1)
    beta = np.zeros_like(scores)
    for t in range(lines - 2, -1, -1):
        new = _lse(step[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
    belief = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    wanted = np.eye(2)[y] * mask[:, :, None]
    emit_grad = np.einsum("dlf,dlk->fk", x, wanted - belief)
    step_grad = np.zeros((2, 2))
    for t in range(1, lines):
        both = mask[:, t]
        pair = np.exp(alpha[:, t - 1, :, None] + step[None] + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
        step_grad += np.einsum("dl,dm->lm", wanted[both, t - 1], wanted[both, t]) - pair[both].sum(axis=0)
    return emit_grad, step_grad


def fit(sequences: list[list[tuple[int, ...]]], labels: list[int], rounds: int = 40, decay: float = 1.0, rate: float = 0.3) -> Field:
    """Maximum likelihood with L2 decay by full-batch Adam; every line of a sequence carries its document's label."""
    pairs = sorted(((s, l) for s, l in zip(sequences, labels) if s), key=lambda p: len(p[0]))
    batches = []
    for start in range(0, len(pairs), 64):
        part = pairs[start:start + 64]
        width = len(part[-1][0])
        x = np.zeros((len(part), width, len(FEATURES)))
        mask = np.zeros((len(part), width), dtype=bool)
        for d, (found, _) in enumerate(part):
            for t, active in enumerate(found):
                x[d, t, list(active)] = 1
            mask[d, :len(found)] = True
        batches.append((x, np.repeat(np.array([[l] for _, l in part]), width, axis=1), mask))
    lines = max(1, sum(int(m.sum()) for _, _, m in batches))
    params = np.zeros(2 * len(FEATURES) + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for turn in range(1, rounds + 1):
        emit, step = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
        grad = -decay * params
        for batch in batches:
            e, s = _batch_gradient(emit, step, *batch)
            grad += np.concatenate([e.ravel(), s.ravel()])
        grad /= lines
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        params = params + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-9)
    return Field(params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2))


def train(docs: DataFrame, ratings: DataFrame, per_grade: int = RATED_PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on the bounded rated sample (grade 1 good, 0 bad); only line features reach the driver. Repeated texts
    count as often as they were drawn; without ratings every line is content."""
    def run(batches):
        for pdf in batches:
            found = [line_features(t.split("\n")) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "grade": pdf["grade"], "ends": [[sum(map(len, f[:i + 1])) for i in range(len(f))] for f in found],
                "active": [[x for line in f for x in line] for f in found],
            })

    sample = rated_sample(docs, ratings, per_grade, id_col, text_col, "grade")
    rows = sample.mapInPandas(run, "doc_id long, grade int, ends array<int>, active array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.grade, r.active))
    found = [[tuple(r.active[a:b]) for a, b in zip([0, *r.ends], r.ends)] for r in rows]
    return fit(found, [CONTENT if r.grade else BOILERPLATE for r in rows])


def repeated_window_words(words: list[bytes], window: int = WORD_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) > n - window:  # a window that repeats holds ``window`` words seen before
        return 0

    def named(left, right):
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    grams = ids
    for k in range(1, window):
        grams = named(grams[:n - k], ids[k:])
    often = np.bincount(grams)[grams] > 1
    cover = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(often)
    cover[starts] += 1
    cover[starts + window] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(text: str | None, field: Field, least_words: int, most_repeated: int, least_content: float) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), text.split("\n")
    n = len(words)
    seen: set[str] = set()
    duplicates = 0
    per_line = [len(l.encode("utf-8", "surrogatepass").split()) for l in lines]
    for line, count in zip(lines, per_line):
        if count:
            duplicates += line in seen
            seen.add(line)
    repeated = repeated_window_words(words)
    failed = n < least_words or 100 * repeated > most_repeated * n
    labels = field.viterbi(line_features(lines)) if n else []
    content = sum(c for c, l in zip(per_line, labels) if l == CONTENT)
    share = content / n if n else 0.0
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, len(text) - spaces, len(SYMBOLS.findall(text)), duplicates, repeated, failed, share, not failed and share >= least_content


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10,
    most_repeated: int = 20, least_content: float = 0.5,
) -> DataFrame:
    """One row per document: ``doc_id`` and the measures; ``kept`` needs the base rules and the share of content words.

    Null and empty texts have no word and fail the base rules. Whole texts are read. Every row is judged, repeated ones alike; an
    empty table gives an empty result; extra columns are ignored.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [measure(t, field, least_words, most_repeated, least_content) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, {MEASURES}")
