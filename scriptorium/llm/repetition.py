"""Repetition inside a document: a linear-chain conditional random field labels its lines as content or repetition.

Plan: one Arrow pass per document and no shuffle of texts. The text is cut into lines (sentences and lines, cut again at
``LINE_WORDS`` words), each described by signs that cost little: how many of its three-word windows were seen earlier in
the text, whether the whole line was, its length and its place. Viterbi decoding of the field labels the lines (in a text
without any old window there is nothing to label), and the share of words in content lines decides whether a document is kept. The field is trained
on lines of a bounded sample that are labelled from another source, runs of eight words that occurred earlier; only where
the field finds a document wanting are these runs looked up again, for the exact share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RUN = 8
LINE_WORDS = 8
WINDOW = 3
#: Documents whose content lines hold at most this share of the words are taken as spoilt candidates.
CONTENT_AT_MOST = 0.95
#: Documents are retained while at least this share of their words stands in content lines.
RETAINED = 0.7
#: Bound of the sample that the field is trained on: documents, those smallest by a hash of the id.
TRAIN_DOCS = 800
TRAIN_LINES = 64
#: The sample is widened until one in so many of its documents has a repeated line, or all documents were read for them.
SPOILT_ONE_IN = 40
WIDEN = 8

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?]\s+|\n+")


class Document(NamedTuple):
    """A text as lines: a number for each word, the first word of each line."""

    words: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """Words of each line."""
        return np.diff(np.append(self.starts, len(self.words)))


def _numbers(words: list[str]) -> np.ndarray:
    # hash() of a word is the same within one process, which is all that one document needs
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)


def _seen(h: np.ndarray, run: int) -> np.ndarray:
    """For each run of ``run`` words whether it occurred earlier; empty for a text that is no longer than one run."""
    n = len(h) - run + 1
    if n <= 1:
        return np.zeros(max(0, n), dtype=bool)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        grams += h[k : n + k] * np.uint64(pow(1000003, k, 2**64))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    out = np.zeros(n, dtype=bool)
    out[order[1:][same]] = True
    return out


def _covered(again: np.ndarray, run: int, n: int) -> np.ndarray:
    """For each of ``n`` words whether one of the marked runs covers it."""
    if not again.any():
        return np.zeros(n, dtype=bool)
    return np.convolve(again.astype(np.int32), np.ones(run, dtype=np.int32)) > 0


def repeated_words(words: list[str] | np.ndarray, run: int = RUN) -> np.ndarray:
    """For each word whether it lies in a run of ``run`` words that already occurred earlier (runs may overlap)."""
    h = words if isinstance(words, np.ndarray) else _numbers(words)
    return _covered(_seen(h, run), run, len(h))


def read_document(text: str | None) -> Document:
    """Words and lines of one text, in one pass. Null and empty texts have none."""
    words: list[str] = []
    starts: list[int] = []
    for sentence in _SENTENCE.split((text or "").lower()):
        at = len(words)
        words += _WORD.findall(sentence)
        starts += range(at, len(words), LINE_WORDS)
    return Document(_numbers(words), np.array(starts, dtype=np.int64))


FEATURES = 6


def line_features(doc: Document, again: np.ndarray | None = None) -> np.ndarray:
    """One row per line: 1, share of its windows seen earlier, whether that is at least a half, whether the line was seen
    earlier, relative length, first line. ``again`` tells for each window whether it was seen earlier."""
    n, lines = len(doc.words), len(doc.starts)
    if not lines:
        return np.zeros((0, FEATURES))
    size = doc.sizes
    seen = np.zeros(n)
    seen[: max(0, n - WINDOW + 1)] = _seen(doc.words, WINDOW) if again is None else again
    windows = np.maximum(1, np.minimum(size, np.maximum(0, n - WINDOW + 1 - doc.starts)))  # windows that begin in the line
    share = np.minimum(1.0, np.add.reduceat(seen, doc.starts) / windows)
    place = (np.arange(n) - np.repeat(doc.starts, size)).astype(np.uint64)
    whole = np.add.reduceat(doc.words * (place * np.uint64(2) + np.uint64(1)) * np.uint64(1000003), doc.starts)
    same_line = _seen(whole, 1) if lines > 1 else np.zeros(lines, dtype=bool)
    first = np.zeros(lines)
    first[0] = 1
    return np.stack([np.ones(lines), share, share >= 0.5, same_line, size / LINE_WORDS, first], axis=1)


def line_labels(doc: Document, run: int = RUN) -> np.ndarray:
    """1 for lines at least half of whose words lie in repeated runs, exactly; what the field learns from."""
    if not len(doc.starts):
        return np.zeros(0, dtype=np.int64)
    marked = repeated_words(doc.words, run).astype(np.float64)
    return (np.add.reduceat(marked, doc.starts) >= 0.5 * doc.sizes).astype(np.int64)


class Field(NamedTuple):
    """Linear-chain conditional random field of two labels (0 content, 1 repetition): emission (6 x 2) and transition (2 x 2)."""

    emission: np.ndarray
    transition: np.ndarray


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def built_in() -> Field:
    """Field for samples that nothing can be learnt from: a line is repetition where more than half its windows are old."""
    return Field(np.array([[0, -4.0], [0, 8.0], *[[0, 0]] * (FEATURES - 2)]), np.zeros((2, 2)))


def train(features: np.ndarray, labels: np.ndarray, mask: np.ndarray, rounds: int = 100, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent over padded sequences (documents x lines), forward-backward for all at once."""
    docs, length, k = features.shape
    w, t = np.zeros((k, 2)), np.zeros((2, 2))
    if len(np.unique(labels[mask > 0])) < 2:
        return built_in()
    truth = np.eye(2)[labels] * mask[..., None]
    seen_w = np.einsum("dlk,dly->ky", features, truth)
    pairs = (mask[:, 1:] * mask[:, :-1])[..., None, None]
    seen_t = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * pairs).sum(axis=(0, 1))
    n = mask.sum()
    for _ in range(rounds):
        score = np.einsum("dlk,ky->dly", features, w)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for i in range(1, length):
            after = _logsumexp(alpha[:, i - 1, :, None] + t, 1) + score[:, i]
            alpha[:, i] = np.where(mask[:, i, None] > 0, after, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            before = _logsumexp(t + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None] > 0, before, 0.0)
        log_z = _logsumexp(alpha[:, -1], 1)
        belief = np.exp(np.clip(alpha + beta - log_z[:, None, None], -50, 0)) * mask[..., None]
        both = alpha[:, :-1, :, None] + t + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        both = np.exp(np.clip(both, -50, 0)) * pairs
        w += rate * ((seen_w - np.einsum("dlk,dly->ky", features, belief)) / n * 10 - decay * w)
        t += rate * ((seen_t - both.sum(axis=(0, 1))) / n * 10 - decay * t)
    return Field(w, t)


def decode(field: Field, features: np.ndarray) -> np.ndarray:
    """Most likely labels of the lines of one document (Viterbi)."""
    score = features @ field.emission
    n = len(score)
    if not n:
        return np.zeros(0, dtype=np.int64)
    back = np.zeros((n, 2), dtype=np.int64)
    (a, b), t = score[0].tolist(), field.transition.tolist()
    for i, (s0, s1) in enumerate(score.tolist()):
        if not i:
            continue
        c0, c1, d0, d1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
        back[i] = (c1 > c0, d1 > d0)
        a, b = max(c0, c1) + s0, max(d0, d1) + s1
    labels = np.zeros(n, dtype=np.int64)
    labels[-1] = b > a
    for i in range(n - 1, 0, -1):
        labels[i - 1] = back[i, labels[i]]
    return labels


def content_share(field: Field, doc: Document) -> float:
    """Share of words in lines labelled content; 1 for a text without words or without a window seen earlier."""
    again = _seen(doc.words, WINDOW)
    if not again.any():
        return 1.0
    labels = decode(field, line_features(doc, again))
    size = doc.sizes
    return float(size[labels == 0].sum() / size.sum())


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, train_docs: int = TRAIN_DOCS) -> Field:
    """Field trained on the lines of at most ``train_docs`` documents, labelled by their repeated runs (:func:`line_labels`).

    The documents are those smallest by a hash of their id, found without reading texts. If too few of them have a
    repeated line, as many more that have one are added, next by the hash, from ever more documents; if all documents
    have too few, the built-in field is taken. Sequences longer than ``TRAIN_LINES`` lines are cut into several.
    """
    h = F.xxhash64(F.col(f"`{doc_id}`"))
    edge = documents.select(h.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [read_document(t) for t in b.column(0).to_pylist()]
            lines = [line_features(d).tolist() for d in docs]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.list_(pa.float64()))), pa.array([line_labels(d, run).tolist() for d in docs], pa.list_(pa.int64()))], names=["lines", "labels"])

    described = lambda part: part.select(F.col(f"`{text}`")).mapInArrow(describe, "lines array<array<double>>, labels array<bigint>")
    if edge is None:
        return built_in()
    lowest, highest = -(1 << 63), (1 << 63) - 1
    kept = described(documents.filter(h <= edge).limit(train_docs)).toArrow().to_pylist()
    wanted = max(1, train_docs // SPOILT_ONE_IN)
    spoilt = sum(any(r["labels"]) for r in kept)
    while spoilt < wanted and edge < highest:
        low, edge = edge + 1, min(highest, lowest + (edge - lowest + 1) * WIDEN)
        more = described(documents.filter(h.between(low, edge))).filter(F.array_contains("labels", 1)).limit(train_docs).toArrow().to_pylist()
        kept, spoilt = kept + more, spoilt + len(more)
    if spoilt < wanted:
        return built_in()
    pieces = [(r["lines"][i : i + TRAIN_LINES], r["labels"][i : i + TRAIN_LINES]) for r in kept for i in range(0, len(r["lines"]), TRAIN_LINES)]
    features, mask = np.zeros((len(pieces), TRAIN_LINES, FEATURES)), np.zeros((len(pieces), TRAIN_LINES))
    labels = np.zeros((len(pieces), TRAIN_LINES), dtype=np.int64)
    for k, (lines, truth) in enumerate(pieces):
        features[k, : len(lines)], labels[k, : len(truth)], mask[k, : len(lines)] = np.array(lines), truth, 1
    return train(features, labels, mask)


def repetition(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", run: int = RUN, field: Field | None = None) -> DataFrame:
    """``doc_id, n_words, content_share, repeated_share`` of every document.

    ``content_share`` is the share of words in lines that the field labels content, 1 for a text without words (null and
    empty ones too). ``repeated_share`` is the exact share of words in repeated runs, looked up where the content share is
    at most ``CONTENT_AT_MOST`` and null elsewhere. Repeated rows give repeated results, an empty table an empty one;
    texts of any length are read whole.
    """
    field = field or fit(documents, doc_id, text, run)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                doc = read_document(t)
                content = content_share(field, doc)
                rows.append((len(doc.words), content, float(repeated_words(doc.words, run).mean()) if content <= CONTENT_AT_MOST else None))
            types = (pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["doc_id", "n_words", "content_share", "repeated_share"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`"))
    return rows.mapInArrow(measure, "doc_id bigint, n_words bigint, content_share double, repeated_share double")


def retention(documents: DataFrame, least: float = RETAINED) -> DataFrame:
    """``doc_id, n_words, content_share, retained`` of every document: whether its content lines hold at least ``least`` of its words."""
    return repetition(documents).select("doc_id", "n_words", "content_share", (F.col("content_share") >= least).alias("retained"))


def p10_found(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents that the field finds wanting and of whose words at least ``least`` lie in repeated runs, exactly."""
    measured = repetition(documents)
    return measured.filter((F.col("content_share") <= CONTENT_AT_MOST) & (F.col("repeated_share") >= least)).select("doc_id").distinct()
