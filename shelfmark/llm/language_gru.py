"""Language of a text by a bidirectional gated recurrent network over its UTF-8 bytes.

Texts are cut into windows of ``WINDOW`` bytes. In each window one recurrent unit reads from the left, another from the
right (Cho et al., Learning Phrase Representations using RNN Encoder-Decoder, 2014, with the reset gate after the recurrent
product), and the two states at a byte give the probabilities of the languages there: every position is labelled. A text's
probabilities are the means over its positions that belong to letters. All windows of a text count, however many it has;
each is read on its own, so memory doesn't grow with a text.

The network is trained in numpy by backpropagation through time with Adam steps, from the labels of positions. It learns
from a bounded sample of the training fold: for each language at most ``SAMPLE`` texts, those with the least hash of their
id, and ``EXAMPLES`` windows of each, spread over the text. Both bounds are independent of the input; the sample and the
weights (some thousand numbers) are what the driver holds.

Defined results: texts that are null or have no letter get ``und`` and score 0, and so does every text when no document of
the training fold has a language and letters. Rows without id belong to the training fold, as their remainder isn't 0.
Languages are taken as they are written, the empty string too; ties go to the first in order. Repeated rows keep their
number, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import fold, one_table, raw_texts
from shelfmark.session import hinted

WINDOW = 64
HIDDEN = 8
SAMPLE = 400
EXAMPLES = 6
# Texts that are ranked for the sample, as a multiple of it: those with hashes below that share of a language's texts.
MARGIN = 4
STEPS = 200
BATCH = 192
RATE = 0.02
SEED = 7
SLOPE = 0.25
UNKNOWN = "und"
# Windows that go through the network at once, and bytes that are cut into windows before.
AT_ONCE = 1024
HELD = 1 << 20

_LETTER_BYTE = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)], np.float32)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace"))))


class Network:
    """Weights, the forward pass, and gradients. The first axis of each weight is the direction of reading."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = SEED, kind: type = np.float32) -> None:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(kind)
        self.weights = {
            "x": drawn(2, 3 * hidden, 256, scale=0.3),  # gates of a byte: update, reset, candidate
            "u": drawn(2, 3 * hidden, hidden, scale=hidden ** -0.5), "b": np.zeros((2, 3 * hidden, 1), kind),
            "o": drawn(2, languages, hidden, scale=hidden ** -0.5), "c": np.zeros((languages, 1), kind)}

    def states(self, windows: np.ndarray, valid: np.ndarray | None, keep: bool = False):
        """States after each byte, (byte, direction, hidden, window); the second direction reads from the end.

        ``valid`` marks the bytes of windows that aren't full; states stay zero until the first of them.
        """
        w, length = self.weights, windows.shape[1]
        n, h = len(windows), w["u"].shape[2]
        bytes_ = np.stack([windows.T, windows.T[::-1]], 1).astype(np.intp)
        seen = None if valid is None else np.stack([valid.T, valid.T[::-1]], 1)[:, :, None, :]
        state, out, kept = np.zeros((2, h, n), w["u"].dtype), [], []
        x = np.empty((2, 3 * h, n), w["u"].dtype)
        gates = w["x"] + np.pad(w["b"][:, :2 * h], ((0, 0), (0, h), (0, 0)))  # the candidate's own bias is inside the reset
        inner = w["b"][:, 2 * h:]
        for t in range(length):
            for side in (0, 1):
                np.take(gates[side], bytes_[t, side], axis=1, out=x[side], mode="clip")
            r = np.matmul(w["u"], state)
            r[:, 2 * h:] += inner
            gate = x[:, :2 * h] + r[:, :2 * h]  # a hard sigmoid: a line between 0 and 1
            gate *= SLOPE
            gate += 0.5
            np.minimum(gate, 1, out=gate)
            np.maximum(gate, 0, out=gate)
            z, reset, turned = gate[:, :h], gate[:, h:], r[:, 2 * h:]
            candidate = reset * turned
            candidate += x[:, 2 * h:]
            np.tanh(candidate, out=candidate)
            if keep:
                kept.append((state, z, reset, turned, candidate))
            state = state - candidate
            state *= z
            state += candidate
            if seen is not None:
                state = state * seen[t]
            out.append(state)
        return np.stack(out), kept, bytes_, seen

    def probabilities(self, windows: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """Of each language at each byte: (byte, language, window)."""
        states = self.states(windows, valid)[0]
        return self._softmax(states)

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        o = self.weights["o"]
        logits = np.matmul(o[0], states[:, 0]) + np.matmul(o[1], states[::-1, 1]) + self.weights["c"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, valid: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of the labelled positions, weighted, and its gradients, back through time."""
        w = self.weights
        h = w["u"].shape[2]
        states, kept, bytes_, seen = self.states(windows, valid, keep=True)
        p = self._softmax(states)
        share = (weight / weight.sum()).T.astype(p.dtype)  # (byte, window)
        own = np.take_along_axis(p, np.broadcast_to(marks, (len(p), 1, len(marks))), 1)[:, 0]
        loss = float(-(np.log(np.maximum(own, 1e-30)) * share).sum())
        d = p
        np.put_along_axis(d, np.broadcast_to(marks, (len(p), 1, len(marks))), (own - 1)[:, None], 1)
        d *= share[:, None]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["c"] = d.sum((0, 2))[:, None]
        sides = np.stack([d, d[::-1]], 1)  # by the step of each reader
        grads["o"] = np.einsum("tdcn,tdhn->dch", sides, states, optimize=True)
        back = np.zeros_like(states[0])
        rows = np.zeros((2, 256, 3 * h), p.dtype)
        for t in reversed(range(len(states))):
            state, z, reset, turned, candidate = kept[t]
            g = back + np.matmul(w["o"].transpose(0, 2, 1), sides[t])
            if seen is not None:
                g = g * seen[t]
            dc = g * (1 - z) * (1 - candidate * candidate)
            dz = g * (state - candidate) * ((z > 0) & (z < 1)) * SLOPE
            dr = dc * turned * ((reset > 0) & (reset < 1)) * SLOPE
            dturned = dc * reset
            into_x = np.concatenate([dz, dr, dc], 1)
            into_r = np.concatenate([dz, dr, dturned], 1)
            grads["u"] += np.matmul(into_r, state.transpose(0, 2, 1))
            grads["b"] += into_r.sum(2, keepdims=True)
            for side in (0, 1):
                np.add.at(rows[side], bytes_[t, side], into_x[side].T)
            back = g * z + np.matmul(w["u"].transpose(0, 2, 1), into_r)
        grads["x"] = rows.transpose(0, 2, 1)
        return loss, grads


def fit(windows: np.ndarray, sizes: np.ndarray, marks: np.ndarray, languages: int, steps: int = STEPS) -> Network:
    """Adam steps over batches with as many windows of each language."""
    net, rng = Network(languages), np.random.default_rng(SEED)
    valid = (np.arange(windows.shape[1]) < sizes[:, None]).astype(np.float32)
    weight = valid * _LETTER_BYTE[windows]
    by_language = [np.flatnonzero(marks == k) for k in range(languages)]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    each = -(-BATCH // languages)
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(own, each) for own in by_language])
        _, grads = net.gradients(windows[at], valid[at], marks[at], weight[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate, clip = RATE * (1 - step / (steps + 1)), max(norm, 1.0)
        for k, g in grads.items():
            g = g / clip
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (rate * first[k] / (1 - 0.9 ** step)
                               / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(net.weights[k].dtype)
    return net


def cut_up(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """The windows of a text, the last one padded with zeros, and the size of the last."""
    n = -(-len(raw) // window)
    return np.frombuffer(raw.ljust(n * window, b"\0"), np.uint8).reshape(n, window), len(raw) - (n - 1) * window


def sample(docs: DataFrame, size: int = SAMPLE, examples: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Windows, their sizes, the numbers of their languages, and the languages in order."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    own = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held & (F.length("text") > 0))
    counts = [(r["lang"], MARGIN * size / r["n"]) for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    shares = own.sparkSession.createDataFrame(counts, "known string, share double")  # a row a language, as in the network
    # The least hashes lie below this share of all hashes; only these texts are ranked.
    below = F.xxhash64("doc_id").cast("double") / 2.0 ** 64 + 0.5 <= F.col("share")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
    chosen = (own.join(hinted(shares, len(counts)), F.col("lang") == F.col("known")).where(below)
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= size))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, places, column in one_table(batches, ["lang", "place", "text"]):
            out = []
            for lang, place, raw in zip(langs.to_pylist(), places.to_pylist(), raw_texts(column)):
                if has_letter(raw):
                    starts = {int(x) for x in np.linspace(0, max(len(raw) - WINDOW, 0), examples)}
                    out += [(lang, place, at, raw[at:at + WINDOW]) for at in sorted(starts)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["lang", "place", "at", "piece"])

    rows = sorted((r["lang"], r["place"], r["at"], bytes(r["piece"])) for r in chosen.select("lang", "place", "text").mapInArrow(
        scan, "lang string, place int, at long, piece binary").collect())  # size * examples pieces a language at most
    rows = [r for r in rows if _LETTER_BYTE[list(r[3])].any()]
    languages = sorted({r[0] for r in rows})
    if not rows:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), languages
    return (np.concatenate([cut_up(r[3])[0] for r in rows]), np.array([len(r[3]) for r in rows]),
            np.array([languages.index(r[0]) for r in rows]), languages)


def train(docs: DataFrame) -> tuple[Network | None, list[str]]:
    windows, sizes, marks, languages = sample(docs)
    return (fit(windows, sizes, marks, len(languages)) if languages else None), languages


def pooled(net: Network, texts: list[bytes], languages: int) -> np.ndarray:
    """Mean probabilities of the languages over the letters of each text; zeros for texts without windows."""
    total, letters = np.zeros((len(texts), languages)), np.zeros(len(texts))
    full: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    short: list[tuple[int, np.ndarray, int]] = []

    def run(windows: np.ndarray, who: np.ndarray, sizes: np.ndarray | None) -> None:
        for at in range(0, len(windows), AT_ONCE):
            own, mine = windows[at:at + AT_ONCE], who[at:at + AT_ONCE]
            valid = None if sizes is None else (np.arange(WINDOW) < sizes[at:at + AT_ONCE, None]).astype(np.float32)
            weight = _LETTER_BYTE[own] if valid is None else _LETTER_BYTE[own] * valid
            p = np.einsum("tcn,nt->nc", net.probabilities(own, valid), weight)
            np.add.at(total, mine, p)
            np.add.at(letters, mine, weight.sum(1))

    def work() -> None:
        if full:
            run(np.concatenate(full), np.concatenate(owners), None)
        if short:
            run(np.stack([w for _, w, _ in short]), np.array([k for k, _, _ in short]), np.array([s for _, _, s in short]))
        full.clear()
        owners.clear()
        short.clear()

    held = 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw), HELD):
            windows, last = cut_up(raw[at:at + HELD])
            if last < WINDOW:
                short.append((k, windows[-1], last))
                windows = windows[:-1]
            full.append(windows)
            owners.append(np.full(len(windows), k))
            held += min(HELD, len(raw) - at)
            if held >= HELD:
                work()
                held = 0
    work()
    return total / np.maximum(letters, 1)[:, None]


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    net, languages = train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(net.weights if net else None)  # a few thousand numbers a language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if languages:
            own = Network(len(languages))
            own.weights = sent.value
        for ids, column in one_table(batches, ["doc_id", "text"]):
            raws = raw_texts(column)
            known = np.array([bool(languages) and has_letter(raw) for raw in raws])
            names, scores = [UNKNOWN] * len(raws), np.zeros(len(raws))
            at = np.flatnonzero(known)
            if len(at):
                p = pooled(own, [raws[k] for k in at], len(languages))
                best = p.argmax(1)
                scores[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
                for k, b in zip(at.tolist(), best.tolist()):
                    names[k] = languages[b]
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
