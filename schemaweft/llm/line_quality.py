"""Quality rules: line sequence labelling.

A linear-chain conditional random field with two states, content and boilerplate, labels the
lines of a document. It is trained on a bounded sample of labelled documents. Their lines' states
are latent: the document's label only says what eight of ten of its lines are, and expectation
maximisation finds which, so a poor document may hold content and a good one boilerplate. Viterbi
decoding marks the lines of any text, and the share of word characters in content lines decides
whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.shingles import WordHashes, mix

#: Labelled documents that the field is trained on, at most, their sequences, and lines of one.
SAMPLE_DOCS, SAMPLE_SEQUENCES, SEQUENCE = 2_000, 8_000, 64
#: Share of a labelled document's lines that are taken to be as its label says.
AS_LABELLED = 0.8
EPOCHS, RATE, RIDGE = 80, 0.15, 1e-3
#: Least share of word characters in content lines that keeps a document.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50
# What counts as a symbol, and as white space between words.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
BOILERPLATE, CONTENT = 0, 1
_HASHES = WordHashes()
_K = np.uint64(0x9E3779B97F4A7C15)
N_FEATURES = 18


def line_features(lines: list[str]) -> np.ndarray:
    """0/1 features of each line: a bias, and steps of its length, symbols, digits and form."""
    out = np.zeros((len(lines), N_FEATURES))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        n = len(line)
        words = line.split()
        symbols = sum(map(line.count, SYMBOLS)) / max(1, n)
        last = line.rstrip()[-1:]
        row = (
            True,
            not words,
            len(words) == 1,
            2 <= len(words) < 5,
            5 <= len(words) < 15,
            len(words) >= 15,
            symbols > 0,
            symbols > 0.02,
            symbols > 0.05,
            symbols > 0.1,
            symbols > 0.2,
            "|" in line,
            last in {".", "!", "?"},
            last.isalpha(),
            line in seen and bool(words),
            sum(map(line.count, "0123456789")) > 0.1 * n > 0,
            line[:1].isupper(),
            "://" in line or "@" in line,
        )
        out[i] = row
        seen.add(line)
    return out


def _odds(scores: np.ndarray) -> np.ndarray:
    """State probabilities of lines that stand alone."""
    return np.exp(scores - np.logaddexp(scores[..., :1], scores[..., 1:]))


class LineField:
    """Weights of the field: emissions (2 x features), transitions (2 x 2) and begin (2)."""

    def __init__(self):
        self.emit, self.step, self.begin = np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2)

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest states; of equally likely ones content."""
        if not len(features):
            return np.zeros(0, np.int64)
        scores = (features @ self.emit.T).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        a, b = self.begin[0] + scores[0][0], self.begin[1] + scores[0][1]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = (a + aa > b + ba), (a + ab > b + bb)
            back.append((not from_a, not from_b))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        state = int(b >= a)
        states = [state]
        for pair in reversed(back):
            state = int(pair[state])
            states.append(state)
        return np.array(states[::-1])

    def fit(self, sequences: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> "LineField":
        """Latent states in two halves, by Adam; a sequence's label leans the states of its lines.

        First lines stand alone, and expectation maximisation finds what each form of line is:
        expected counts with the label's odds on each line, less those without. What comes out,
        with those odds, are soft states of all lines; the whole field is then fitted to them, so
        that steps are learnt from what follows what inside documents, not from the labels.
        """
        length = max(map(len, sequences))
        x = np.zeros((length, len(sequences), N_FEATURES))
        there = np.zeros((length, len(sequences)))
        for j, s in enumerate(sequences):
            x[: len(s), j] = s
            there[: len(s), j] = 1
        lean = np.log(AS_LABELLED / (1 - AS_LABELLED)) * np.eye(2)[np.array(labels)]
        weights = [self.emit, self.step, self.begin]
        slow, quick = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        total = there.sum()
        for epoch in range(1, epochs + 1):
            scores = x @ self.emit.T
            alone = 2 * epoch <= epochs
            if alone or 2 * (epoch - 1) <= epochs:
                wanted = _odds(scores + lean) * there[:, :, None]
                wanted_pair = np.einsum("tja,tjb->ab", wanted[:-1], wanted[1:])
            state, pair = (_odds(scores) * there[:, :, None], wanted_pair) if alone else self._marginals(scores, there)
            off = wanted - state
            gradients = [np.einsum("tjs,tjf->sf", off, x), wanted_pair - pair, off[0].sum(0) * (not alone)]
            for w, g, m, v in zip(weights, gradients, slow, quick):
                g = g / total - RIDGE * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        return self

    def _marginals(self, scores: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities by place and sequence, and expected transitions, summed."""
        length = len(scores)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = self.begin + scores[0]
        total = lambda a: np.logaddexp(a[..., 0], a[..., 1])
        for t in range(1, length):
            new = total(np.moveaxis(ahead[t - 1][:, :, None] + self.step, 1, 2)) + scores[t]
            ahead[t] = np.where(there[t][:, None] > 0, new, ahead[t - 1])
        for t in range(length - 2, -1, -1):
            new = total(self.step + (behind[t + 1] + scores[t + 1])[:, None, :])
            behind[t] = np.where(there[t + 1][:, None] > 0, new, 0)
        whole = total(ahead[-1])
        state = np.exp(ahead + behind - whole[None, :, None]) * there[:, :, None]
        joint = ahead[:-1, :, :, None] + self.step + (scores[1:] + behind[1:])[:, :, None, :] - whole[None, :, None, None]
        return state, (np.exp(joint) * there[1:, :, None, None]).sum((0, 1))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_sequences: int = SAMPLE_SEQUENCES) -> LineField:
    """A field fitted to the ``sample_docs`` labelled documents with the least id hashes, and of
    their sequences of 64 lines to the ``sample_sequences`` with the least hashes.

    ``labels`` has doc_id and quality (1 good, 0 poor). Rows without either teach nothing; with
    nothing to learn from, every line is content. Tasks turn lines into features; no text comes
    to the driver, only a number of 18 bits a line.
    """
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, good, starts, bits = [], [], [], []
            for doc_id, text, quality in zip(*(batch.column(i).to_pylist() for i in range(3))):
                numbers = (line_features(text.split("\n")) @ (1 << np.arange(N_FEATURES))).astype(np.int32)
                for at in range(0, len(numbers), SEQUENCE):
                    ids.append(doc_id)
                    good.append(quality == 1)
                    starts.append(at)
                    bits.append(numbers[at : at + SEQUENCE])
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()))
            columns = [pa.array(c, k) for c, k in zip((ids, good, starts, bits), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "good", "start", "bits"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(few), "doc_id").filter("text is not null")
    made = rows.select("doc_id", "text", "quality").mapInArrow(sequences, "doc_id bigint, good boolean, start bigint, bits array<int>")
    chosen = made.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "good", "bits").limit(sample_sequences).collect()
    features = [np.array(r.bits)[:, None] >> np.arange(N_FEATURES) & 1 for r in chosen]
    field = LineField()
    return field.fit(features, [int(r.good) for r in chosen]) if chosen else field


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "replace").split()
    seen, same = set(), 0
    for line in text.split("\n"):
        same += line in seen and bool(line.strip(SPACE))
        seen.add(line)
    repeated = 0
    if len(words) >= 3:
        h = _HASHES.of(words)
        windows = mix((h[:-2] * _K + h[1:-1]) * _K + h[2:])
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.append(counts[inverse] >= 2, [False, False])
        repeated = int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), same, repeated


def judge(docs: DataFrame, field: LineField, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id and the base counts, base_failed, content_share, boilerplate (line numbers, from 0)
    and kept of every row of ``docs`` (doc_id, text).

    NULL and empty texts have no words and fail. Repeated rows are judged alike; other columns
    are ignored. A text of lines without words has the content share 0.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                counts = base_counts(text)
                lines = text.split("\n")
                states = field.viterbi(line_features(lines))
                weight = np.array([len(x) - sum(map(x.count, SPACE)) for x in lines])
                content = float(weight[states == CONTENT].sum() / max(1, weight.sum()))
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
                rows.append((*counts, failed, content, np.flatnonzero(states == BOILERPLATE).tolist(), not failed and content >= share))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=NAMES)

    kinds = ["bigint"] * 6 + ["boolean", "double", "array<int>", "boolean"]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(judged, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "boilerplate", "kept"]
