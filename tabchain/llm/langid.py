"""Language identification by a bidirectional gated recurrent network over bytes.

Every position of a text gets probabilities from the states of both directions,
and a document's are the mean over its positions. Texts are read in segments of a
fixed number of bytes, each from a fresh state, so a batch holds many segments of
many documents and no text is too long. The network is trained in numpy by
backpropagation through time on a bounded number of segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a segment, states per direction.
SEGMENT, STATES = 64, 8
#: The training sample: documents per language, segments per document.
DOCS_PER_LANGUAGE, SEGMENTS_PER_DOC = 300, 6
STEPS, BATCH, RATE = 220, 192, 0.02
#: Segments that are read side by side.
READ_BATCH = 2048
#: Characters of documents whose sums are kept at a time.
GROUP_CHARS = 1 << 22
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights: per direction input tables, recurrence and bias, and the output layer.

    ``tables[d]`` is (3 states, 256): what a byte adds to update gate, reset gate
    and candidate. ``recur[d]`` is (3 states, states). ``out`` is
    (languages, 2 states).
    """

    languages: list[str]
    tables: list[np.ndarray]
    recur: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], states: int = STATES, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages,
            [draw(3 * states, 256, scale=0.5) for _ in range(2)],
            [draw(3 * states, states, scale=0.35) for _ in range(2)],
            [np.zeros((3 * states, 1), np.float32) for _ in range(2)],
            draw(len(languages), 2 * states, scale=0.3),
            np.zeros((len(languages), 1), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recur, *self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def run_direction(net: Network, d: int, symbols: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (time, states, batch); ``symbols`` is (time, batch), direction 1 runs backwards."""
    steps, batch = symbols.shape
    s = net.recur[d].shape[1]
    states = np.empty((steps, s, batch), np.float32)
    h = np.zeros((s, batch), np.float32)
    table, recur = net.tables[d] + net.bias[d], net.recur[d]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        given = table.take(symbols[t], axis=1)
        back = recur @ h
        gates = given[: 2 * s]
        gates += back[: 2 * s]
        _sigmoid(gates)
        update, reset = gates[:s], gates[s:]
        candidate = given[2 * s :]
        candidate += reset * back[2 * s :]
        np.tanh(candidate, out=candidate)
        new = candidate - h
        new *= update
        new += h
        if mask is not None:
            new *= mask[t]
        if keep is not None:
            keep.append((t, h, update, reset, candidate, back[2 * s :]))
        h = states[t] = new
    return states


def position_probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(time, languages, batch)"""
    s = forward.shape[1]
    x = np.matmul(net.out[:, :s], forward)
    x += np.matmul(net.out[:, s:], backward)
    x += net.out_bias
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def loss_and_gradients(net: Network, symbols: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over unmasked positions, and its gradient by ``weights()``."""
    kept: list[list] = [[], []]
    states = [run_direction(net, d, symbols, mask, kept[d]) for d in range(2)]
    p = position_probabilities(net, *states)
    total = mask.sum()
    batch = np.arange(symbols.shape[1])
    loss = float(-(np.log(p[:, target, batch] + 1e-9) * mask).sum() / total)
    p[:, target, batch] -= 1
    p *= (mask / total)[:, None, :]
    both = np.concatenate(states, axis=1)
    g_out = np.einsum("tcb,tsb->cs", p, both, optimize=True).astype(np.float32)
    g_out_bias = p.sum(axis=(0, 2))[:, None]
    tables, recurs, biases = [], [], []
    for d in range(2):
        s = net.recur[d].shape[1]
        into = np.matmul(net.out[:, d * s : (d + 1) * s].T, p)
        g_recur = np.zeros_like(net.recur[d])
        inputs = np.empty((symbols.shape[0], 3 * s, symbols.shape[1]), np.float32)
        carried = np.zeros((s, symbols.shape[1]), np.float32)
        for t, h, update, reset, candidate, back in reversed(kept[d]):
            g = (into[t] + carried) * mask[t]
            g_c = g * update * (1 - candidate * candidate)
            g_u = g * (candidate - h) * update * (1 - update)
            g_r = g_c * back * reset * (1 - reset)
            inputs[t] = np.concatenate([g_u, g_r, g_c])
            through = np.concatenate([g_u, g_r, g_c * reset])
            g_recur += through @ h.T
            carried = g * (1 - update) + net.recur[d].T @ through
        flat = inputs.transpose(1, 0, 2).reshape(3 * s, -1)
        codes = symbols.reshape(-1)
        tables.append(np.stack([np.bincount(codes, row, 256) for row in flat]).astype(np.float32))
        biases.append(flat.sum(axis=1, keepdims=True))
        recurs.append(g_recur)
    return loss, [*tables, *recurs, *biases, g_out, g_out_bias.astype(np.float32)]


def segment_matrix(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, (time, pieces); a piece longer than a segment is cut."""
    symbols = np.zeros((len(pieces), SEGMENT), np.uint8)
    mask = np.zeros((len(pieces), SEGMENT), np.float32)
    for k, piece in enumerate(pieces):
        cut = piece[:SEGMENT]
        symbols[k, : len(cut)] = np.frombuffer(cut, np.uint8)
        mask[k, : len(cut)] = 1
    return np.ascontiguousarray(symbols.T), np.ascontiguousarray(mask.T)


def train(pieces: list[bytes], names: list[str], steps: int = STEPS) -> Network:
    """Adam over balanced batches; the same input gives the same network."""
    languages = sorted(set(names))
    net = Network.fresh(languages)
    symbols, mask = segment_matrix(pieces)
    target = np.array([languages.index(n) for n in names])
    members = [np.flatnonzero(target == k) for k in range(len(languages))]
    rng = np.random.default_rng(11)
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(m, max(1, BATCH // len(members))) for m in members])
        _, gradients = loss_and_gradients(net, symbols[:, chosen].astype(np.int64), mask[:, chosen], target[chosen])
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def training_pieces(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Evenly spaced segments of ``per_language`` documents of each language, by hash.

    Only the first rows of each language leave a task, and of them only segments.
    """
    text = F.col("text")
    room = F.greatest(F.length(text) - SEGMENT, F.lit(0))
    pieces = [
        F.substring(text, (room * k / (SEGMENTS_PER_DOC - 1)).cast("int") + 1, F.lit(SEGMENT))
        for k in range(SEGMENTS_PER_DOC)
    ]
    order = Window.partitionBy("lang").orderBy("drawn", "pieces")
    rows = (
        labelled.filter("lang is not null and text <> ''")
        .select("lang", F.xxhash64("doc_id").alias("drawn"), F.array_distinct(F.array(*pieces)).alias("pieces"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_language)
        .orderBy("lang", "place")
        .select("lang", "pieces")
        .collect()
    )
    found = [(p.encode(), r.lang) for r in rows for p in r.pieces if _LETTER.search(p)]
    return [p for p, _ in found], [n for _, n in found]


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text, (texts, languages)."""
    sums = np.zeros((len(texts), len(net.languages)))
    whole = [np.frombuffer(t, np.uint8)[: len(t) - len(t) % SEGMENT].reshape(-1, SEGMENT) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in whole])
    rests = [k for k, t in enumerate(texts) if len(t) % SEGMENT]

    def read(symbols: np.ndarray, mask: np.ndarray | None, owners: np.ndarray) -> None:
        p = position_probabilities(net, *(run_direction(net, d, symbols, mask) for d in range(2)))
        if mask is not None:
            p *= mask[:, None, :]
        per_segment = p.sum(axis=0)
        for c in range(len(net.languages)):
            sums[:, c] += np.bincount(owners, per_segment[c], len(texts))

    full = np.concatenate(whole) if whole else np.empty((0, SEGMENT), np.uint8)
    for at in range(0, len(full), READ_BATCH):
        part = slice(at, at + READ_BATCH)
        read(np.ascontiguousarray(full[part].T).astype(np.intp), None, owner[part])
    for at in range(0, len(rests), READ_BATCH):
        part = rests[at : at + READ_BATCH]
        symbols, mask = segment_matrix([texts[k][len(texts[k]) - len(texts[k]) % SEGMENT :] for k in part])
        read(symbols.astype(np.intp), mask, np.array(part))
    return sums / np.maximum([len(t) for t in texts], 1)[:, None]


def predicted(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text, read in groups of bounded size."""
    names: list[str] = []
    scores: list[float] = []
    while len(names) < len(texts):
        group, size = [], 0
        while len(names) + len(group) < len(texts) and (not group or size < GROUP_CHARS):
            text = texts[len(names) + len(group)].as_py()
            group.append(text if text and net is not None and _LETTER.search(text) else "")
            size += len(group[-1])
        if net is None:
            names += [UNKNOWN] * len(group)
            scores += [0.0] * len(group)
            continue
        p = document_probabilities(net, [t.encode() for t in group])
        for text, row, best in zip(group, p, p.argmax(axis=1), strict=True):
            names.append(net.languages[best] if text else UNKNOWN)
            scores.append(min(1.0, float(row[best])) if text else 0.0)
    return names, scores


def predict_languages(
    docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from its whole text.

    ``score`` is the language's mean probability over the positions. A null text, or
    one without any letter, is ``und`` with score 0; so is every text if there was
    no labelled one to learn from (``net`` is None). The first language by name wins
    a tie. Rows that repeat are read each for itself. Other columns are ignored. No
    rows give no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(net, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=_ARROW
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, SCHEMA)


def accepted(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, in a known language with a score of ``least``."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(net, batch.column(at))
            good = [n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, held_out, per_language: int = DOCS_PER_LANGUAGE, steps: int = STEPS) -> DataFrame:
    """Train on the rows for which ``held_out`` is false, predict all rows.

    ``docs`` holds ``doc_id, text, lang``; rows without a language train nothing.
    """
    pieces, names = training_pieces(docs.filter(~held_out | held_out.isNull()), per_language)
    return predict_languages(docs, train(pieces, names, steps) if pieces else None)
