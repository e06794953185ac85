"""Personal data: fixed base patterns, and a linear-chain conditional random field over word shapes.

The field labels words with the begin or inside of a kind, or outside. It is trained on the driver from a small labelled
table (``pii_labels``) by gradient ascent on the conditional log-likelihood, and decoded by Viterbi over batches of equal
sequences in numpy. Words without a digit or ``@`` are bound to "outside". A word bound to one label separates what
stands before and behind it, so only runs of the other words need decoding, which changes no result.

Base spans always stay; the field adds spans that overlap none of them. Defined results: a null text is empty and has no
spans; rows are handled one by one, whatever their doc_id; an empty table gives no rows; extra columns are kept by
``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import one_table, texts
from shelfmark.llm.pii_labels import KINDS, SENTENCES
from shelfmark.llm.spans import SPAN_DDL, SPAN_TYPE, Span, apart, as_structs, ordered, replaced

# ------------------------------------------------------------------ base patterns

# Fixed patterns of the contract, with runs taken as a whole. An e-mail is found from its "@": a run of name characters
# before it that doesn't reach into the match before, and a domain behind it.
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base matches, by start and kind."""
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _NAME:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(n) <= 3 and int(n or "0") <= 255 for n in (p.lstrip("0") for p in m[0].split("."))):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return ordered(out, KINDS)


# ------------------------------------------------------------------ the field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_CUES = frozenset(
    "call phone tel telefon mobile fax text ring number contact whatsapp email mail address write reply send ip host "
    "server ping gateway from card credit visa amex carte karte charged llame appelez version isbn page chapter line "
    "section order room key token password in the year to".split())
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{,;:", "\"'>]},;:.!?"


def shape(word: str) -> str:
    """Character classes: letters a, digits by the length of their run up to 5, other characters as they are."""
    out = []
    for kind, run in groupby(word, key=lambda c: "9" if c in "0123456789" else "a" if c.isalpha() else c):
        n = sum(1 for _ in run)
        out.append("a" if kind == "a" else f"9{min(n, 5)}" if kind == "9" else kind * min(n, 2))
    return "".join(out)


def features(words: list[str], at: int) -> list[str]:
    """Of the word at ``at``; words beside it may be missing."""
    word = words[at]
    core = word.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
    own = shape(core)
    digits = sum(c in "0123456789" for c in word)

    def beside(k: int, name: str) -> list[str]:
        if not 0 <= k < len(words):
            return [f"{name}:none"]
        other = words[k].lower().strip(_EDGE_LEFT + _EDGE_RIGHT)
        marked = bool(_MARK.search(words[k]))
        return [f"{name}:{shape(other)}" if marked else f"{name}:word"] + [f"{name}={other}"] * (other in _CUES)

    return [f"shape:{own}", f"digits:{min(digits, 17)}", f"at:{'@' in core[1:-1]}", f"dots:{min(core.count('.'), 4)}",
            f"signs:{''.join(sorted(set(c for c in core if not c.isalnum())))[:6]}", f"letters:{any(map(str.isalpha, core))}",
            "bias", *beside(at - 1, "before"), *beside(at + 1, "after")]


def _free(word: str) -> bool:
    return bool(_MARK.search(word))


class Field:
    """Weights of a linear chain: features by label, and label by next label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, words: list[str], at: int) -> np.ndarray:
        known = [self.names[f] for f in features(words, at) if f in self.names]
        return self.emit[known].sum(axis=0)

    def decode(self, runs: list[np.ndarray]) -> list[list[int]]:
        """Best labels of each run of scores; a run stands between words that are outside. Equal lengths go together."""
        out: list[list[int]] = [[] for _ in runs]
        by_length = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        for length, same in groupby(by_length, key=lambda k: len(runs[k])):
            rows = list(same)
            score = np.stack([runs[k] for k in rows])  # runs, words, labels
            best = score[:, 0] + self.step[0]
            back = np.zeros((len(rows), length, len(LABELS)), dtype=np.int8)
            for t in range(1, length):
                through = best[:, :, None] + self.step[None]
                back[:, t] = through.argmax(axis=1)
                best = through.max(axis=1) + score[:, t]
            label = (best + self.step[:, 0]).argmax(axis=1)
            path = [label]
            for t in range(length - 1, 0, -1):
                label = back[np.arange(len(rows)), t, label]
                path.append(label)
            for row, labels in zip(rows, np.stack(path[::-1], axis=1).tolist()):
                out[row] = labels
        return out


# Inside follows only begin or inside of its kind.
_FORBIDDEN = np.array([[0.0 if not b.startswith("I") or a[1:] == b[1:] else -1e4 for b in LABELS] for a in LABELS])


def _examples(sentences: list[str]) -> list[tuple[list[str], list[int]]]:
    out = []
    for sentence in sentences:
        words, labels = [], []
        for part in re.split(r"(\{\w+:[^}]*\}\S*)", sentence):
            m = re.fullmatch(r"\{(\w+):([^}]*)\}(\S*)", part)
            own = _WORD.findall(m[2] + m[3] if m else part)
            words += own
            labels += [LABELS.index(f"{'I' if k else 'B'}-{m[1]}") if m else 0 for k in range(len(own))]
        # Words of a span without a digit or "@" can't be marked; the base patterns need none of them.
        out.append((words, [x if _free(w) else 0 for w, x in zip(words, labels)]))
    return out


def train(sentences: list[str] = SENTENCES, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent on the conditional log-likelihood, with forward and backward sums in logarithms."""
    examples = _examples(sentences)
    names: dict[str, int] = {}
    coded = []
    for words, labels in examples:
        coded.append(([[names.setdefault(f, len(names)) for f in features(words, t)] for t in range(len(words))], labels,
                      [_free(w) for w in words]))
    emit = np.zeros((len(names), len(LABELS)))
    step = np.zeros((len(LABELS), len(LABELS)))
    past_emit, past_step = np.full_like(emit, 1e-8), np.full_like(step, 1e-8)
    closed = np.where(np.arange(len(LABELS)) == 0, 0.0, -1e4)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for _ in range(rounds):
        up_emit, up_step = -decay * emit, -decay * step
        moves = step + _FORBIDDEN
        for feats, labels, free in coded:
            score = np.stack([emit[f].sum(axis=0) + (0 if open_ else closed) for f, open_ in zip(feats, free)])
            n = len(labels)
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = score[0] + moves[0]
            for t in range(1, n):
                ahead[t] = logsum(ahead[t - 1][:, None] + moves, 0) + score[t]
            behind[-1] = moves[:, 0]
            for t in range(n - 2, -1, -1):
                behind[t] = logsum(moves + (score[t + 1] + behind[t + 1])[None], 1)
            total = logsum(ahead[-1] + behind[-1], 0)
            share = np.exp(ahead + behind - total)
            for t in range(n):
                for f in feats[t]:
                    up_emit[f] -= share[t]
                    up_emit[f, labels[t]] += 1
            path = [0, *labels, 0]
            for a, b in zip(path, path[1:]):
                up_step[a, b] += 1
            up_step[0] -= share[0]
            up_step[:, 0] -= share[-1]
            for t in range(1, n):
                up_step -= np.exp(ahead[t - 1][:, None] + moves + (score[t] + behind[t])[None] - total)
        past_emit += up_emit ** 2
        past_step += up_step ** 2
        emit += rate * up_emit / np.sqrt(past_emit)
        step += rate * up_step / np.sqrt(past_step)
    return Field(names, emit, step + _FORBIDDEN)


def _runs(text: str) -> list[tuple[list[str], list[tuple[int, int]], int]]:
    """Runs of words with a digit or "@": words with one more on each side, places of the run, first in the words."""
    places: list[list[tuple[int, int]]] = []
    at, last = 0, -1
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.end())
        at = space.start() if space else len(text)
        if places and text[last:start].isspace():
            places[-1].append((start, at))
        else:
            places.append([(start, at)])
        last = at
    out = []
    for run in places:
        end = run[0][0]
        while end > 0 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        before = [text[start:end]] if start < end else []
        after = _WORD.search(text, run[-1][1])
        out.append(([*before, *(text[s:e] for s, e in run), *([after[0]] if after else [])], run, len(before)))
    return out


def field_spans(field: Field, batch: list[str]) -> list[list[Span]]:
    """What the field finds in each text."""
    owners, places, scores = [], [], []
    for row, text in enumerate(batch):
        for words, run, first in _runs(text):
            owners.append(row)
            places.append(run)
            scores.append(np.stack([field.scores(words, first + k) for k in range(len(run))]))
    out: list[list[Span]] = [[] for _ in batch]
    for row, run, labels in zip(owners, places, field.decode(scores)):
        open_: list | None = None
        text = batch[row]
        for (start, end), label in zip(run, labels):
            name = LABELS[label]
            while start < end and text[start] in _EDGE_LEFT:
                start += 1
            while end > start and text[end - 1] in _EDGE_RIGHT:
                end -= 1
            if name.startswith("I") and open_:
                open_[1] = end
            else:
                if open_:
                    out[row].append(tuple(open_))
                open_ = [start, end, name[2:]] if name != "O" and start < end else None
        if open_:
            out[row].append(tuple(open_))
    return out


def _all_spans(field: Field, batch: list[str]) -> list[tuple[list[Span], list[Span]]]:
    marked = [t if _MARK.search(t) else "" for t in batch]
    out = []
    for text, extra in zip(marked, field_spans(field, marked)):
        base = base_spans(text) if text else []
        out.append((base, ordered([*base, *apart(extra, base)], KINDS)))
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base (the base spans) and spans (all) of every row."""
    model = field or train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, column in one_table(batches, ["doc_id", "text"]):
            found = _all_spans(model, texts(column))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([as_structs(b) for b, _ in found], SPAN_TYPE),
                 pa.array([as_structs(s) for _, s in found], SPAN_TYPE)], names=["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, base {SPAN_DDL}, spans {SPAN_DDL}")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars``, if there, set to the new length."""
    model = field or train()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            found = _all_spans(model, [t or "" for t in column])
            if any(spans for _, spans in found):
                new = [replaced(t, s) if s else t for t, (_, s) in zip(column, found)]
                for name, values in (("text", new), ("n_chars", [None if t is None else len(t) for t in new])):
                    if name in batch.schema.names:
                        k = batch.schema.names.index(name)
                        field_ = batch.schema.field(k)
                        old = batch.column(k).to_pylist()
                        merged = [v if s else o for v, o, (_, s) in zip(values, old, found)]
                        batch = batch.set_column(k, field_, pa.array(merged, field_.type))
            yield batch

    return docs.mapInArrow(scan, docs.schema)
