"""Pairs above a threshold where names say too little to meet by: everything is compared, block against block.

The rows are sorted into blocks of neighbouring titles, or of neighbouring artists where these are few. Two blocks are one
group of a shuffle; a row goes to those groups only in which its letters can do for a row of the other block. For the rows
that meet one product of two matrices holds, for every pair, what the score can be at most: two names within d edits share
all but d of the letters of the longer one. Where few artists have many rows, the distance of each two artists is computed
first and only the titles of close ones are multiplied. Where names are numbered series, their first and last parts are few:
the distance of two names is the least of first part to a beginning plus last part to the rest, and both are read from
tables, so that a pair costs some additions. What is left is cut by edit distance, first of the titles, computed
for many pairs at once. No pair at or above the threshold is dropped on the way, and Spark computes the score of those that
are left.

A task holds two blocks and a slice of their product, however many pairs it finds.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.functions import text as tx
from shelfmark.session import materialize

# Tasks get these functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARTIST, TITLE, COUNT = tx.ARTIST_WEIGHT, tx.TITLE_WEIGHT, tx.COUNT_WEIGHT
# Rows of a block, and blocks that even a small table is cut into.
BLOCK = 16384
BLOCKS = 24
# Cells of a product that are held at a time, pairs whose distance is computed at a time, pairs of a batch that is returned.
CELLS, PAIRS, BATCH = 1 << 19, 1 << 13, 1 << 15
# Beyond this many different track counts they are taken to agree.
MOST_COUNTS = 64
# Rows that an artist has on the average where rows are sorted by artist and the artists are compared first.
MANY_ROWS = 64
# What blocks say of their letters is told by the last bits of each letter, whatever the alphabet.
FOLDED = 256
# Names are put together from tables of their parts if these are so many times fewer than the rows, all names are no longer
# and the rows of a block differ in length at most in so many ways.
FEWER, LONGEST_IN_PARTS, MOST_SIZES = 12, 100, 16
# Places to either side at which the other artist and title are cut; farther ones count as the edits that they need.
SHIFTS = 1, 2
# Rows whose sizes fewer than one in so many have are not looked up but left to the edit distance.
RARE = 200
# Names that begin with so many letters are cut free of their common beginning by first letter.
FIRST_LETTERS = 4
# Rows of a table of parts, a loss of 1 in numbers of 16 bits, and no distance.
SLICE, UNIT, FAR = 1 << 13, 40000, 127
# Groups of the shuffle that are dealt out to as many tasks.
MOST_PARTS = 2000
# A word of this many bits holds the letters of a name that are equal to one letter.
WORD = 63
# Single precision of the product, double precision of a sum of losses.
ROUGH, FINE = 1e-4, 1e-7


class Names:
    """Names of one block as numbers of letters, 0 to ``letters - 1``; an empty name is one letter of its own."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, letters: int) -> None:
        self.codes, self.size, self.letters = codes, size, letters
        self.counts = np.zeros((len(size), letters), np.int16)
        for i in range(codes.shape[1]):
            rows = np.flatnonzero(size > i)
            self.counts[rows, codes[rows, i]] += 1

    def of(self, keep: np.ndarray) -> Names:
        out = object.__new__(Names)
        out.codes, out.size, out.counts, out.letters = self.codes[keep], self.size[keep], self.counts[keep], self.letters
        return out

    def texts(self) -> list[tuple]:
        return [tuple(codes[:n]) for codes, n in zip(self.codes.tolist(), self.size.tolist())]


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each text, and how many it has; an empty one has a letter of its own."""
    filled = [s or "\0" for s in texts]
    size = np.array([len(s) for s in filled], np.int64)
    return np.array(filled, dtype=f"U{size.max()}").view(np.uint32).reshape(len(filled), -1), size


def numbered(xs: list[str], ys: list[str]) -> tuple[Names, Names]:
    texts, size = spelled(xs + ys)
    known = np.zeros(int(texts.max()) + 1, bool)
    known[texts] = True
    codes = (np.cumsum(known) - 1)[texts]
    x, y = (Names(codes[part], size[part], int(known.sum())) for part in (slice(0, len(xs)), slice(len(xs), None)))
    return x, y


def shared_at_most(x: Names, y: Names) -> np.ndarray:
    """For each name of ``x``, how similar a name of ``y`` can be at most."""
    shared = np.minimum(x.counts, y.counts.max(0)).sum(1)
    return np.minimum(1.0, shared / np.maximum(x.size, y.size.min()))


def distinct(x: Names) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct name, and the number of its name for each row."""
    codes = np.where(np.arange(x.codes.shape[1]) < x.size[:, None], x.codes, -1).astype(np.int32)
    whole = np.ascontiguousarray(codes).view(f"V{codes.shape[1] * 4}").ravel()
    _, rows, number = np.unique(whole, return_index=True, return_inverse=True)
    return rows, number.ravel()


def letter_columns(x: Names, y: Names) -> tuple[np.ndarray, np.ndarray]:
    """The first, second, ... of each letter as a column of 0 and 1: products of rows count the shared letters."""
    most = np.minimum(x.counts.max(0), y.counts.max(0))
    letter = np.repeat(np.arange(len(most)), most)
    nth = np.concatenate([np.arange(1, m + 1) for m in most] or [np.zeros(0, int)])
    return tuple((side.counts[:, letter] >= nth).astype(np.float32) for side in (x, y))


def count_similarity(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    high = np.maximum(np.maximum(n1, n2), 1).astype(float)
    return np.where((n1 > 0) & (n2 > 0), 1 - np.abs(n1 - n2) / high, 0.5)


def edits(x: Names, y: Names) -> Callable:
    """Edit distance of names ``i`` of x and ``j`` of y by bit vectors (Myers, Hyyro); 0 if one is too long for a word."""
    start, least = 0, min(x.size.min(), y.size.min())
    while start < least and (x.codes[:, start] == x.codes[0, start]).all() and (y.codes[:, start] == x.codes[0, start]).all():
        start += 1
    width, length = x.size - start, y.size - start
    fits = min(int(width.max()), WORD)
    word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if fits < 8 * np.dtype(w).itemsize)
    one = word(1)
    places = np.zeros((len(width), x.letters), word)
    for k in range(fits):
        rows = np.flatnonzero(width > k)
        places[rows, x.codes[rows, start + k]] |= word(1 << k)
    places, columns = places.ravel(), np.ascontiguousarray(y.codes[:, start:].T)

    def of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
            left = length[b]
            order = None
            if left.min() < left.max():  # the longer ones first, so that those that have a next letter stay together
                order = np.argsort(-left, kind="stable")
                a, b, left = a[order], b[order], left[order]
            m = width[a]
            last = np.maximum(np.minimum(m, WORD) - 1, 0).astype(word)
            up, down = np.full(len(a), ~word(0)), np.zeros(len(a), word)
            far, row = m.astype(np.int32), a * x.letters
            for k in range(int(left[0])):
                n = len(left) if order is None else int(np.searchsorted(-left, -k, side="left"))
                vp, vn = up[:n], down[:n]
                eq = places.take(row[:n] + columns[k].take(b[:n]))
                d0 = (((eq & vp) + vp) ^ vp) | eq | vn
                hp, hn = vn | ~(d0 | vp), d0 & vp
                far[:n] += ((hp >> last[:n]) & one).astype(np.int32)
                far[:n] -= ((hn >> last[:n]) & one).astype(np.int32)
                hp = (hp << one) | one
                up[:n], down[:n] = (hn << one) | ~(d0 | hp), hp & d0
            far = np.where(m == 0, left, np.where(m > WORD, 0, far))
            out[at + order if order is not None else slice(at, at + len(a))] = far
        return out
    return of


class Parts:
    """Names of ``x`` cut before their last ``k`` letters: distinct first and last parts, and those of each row."""

    def __init__(self, x: Names) -> None:
        texts = x.texts()
        for k in range(1, int(x.size.min()) + 1):
            first, last = {}, {}
            self.first = np.array([first.setdefault(s[:-k], len(first)) for s in texts])
            self.last = np.array([last.setdefault(s[-k:], len(last)) for s in texts])
            if len(first) <= len(last):
                break
        self.k, self.firsts, self.lasts, self.letters = k, list(first), list(last), x.letters

    def few(self, rows: int) -> bool:
        return (FEWER * (len(self.firsts) + len(self.lasts)) <= rows
                and max(map(len, self.firsts)) <= WORD and self.k <= WORD)

    def tables(self, y: Names, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Edits of each first part to the beginnings of each name of ``y`` that are ``low`` to ``high`` letters longer, and
        of each last part to such ends; FAR where there is none."""
        turned = np.zeros_like(y.codes)
        for size in np.unique(y.size):
            rows = y.size == size
            turned[rows, :size] = y.codes[rows, :size][:, ::-1]
        return (from_start(self.firsts, y.codes, y.size, self.letters, low, high),
                from_start([s[::-1] for s in self.lasts], turned, y.size, self.letters, low, high))


def from_start(parts: list[tuple], codes: np.ndarray, size: np.ndarray, letters: int, low: int, high: int) -> np.ndarray:
    """Edits of each of ``parts`` to the first letters of each row, ``low`` to ``high`` more than it has (Myers, Hyyro)."""
    out = np.empty((len(parts), high - low + 1, len(size)), np.uint8)
    begins = np.array([s[0] if s else -1 for s in parts])
    if 1 < len(np.unique(begins)) + len(np.unique(codes[:, 0])) <= 2 * FIRST_LETTERS:
        for x in np.unique(begins):
            of = np.flatnonzero(begins == x)
            for y in np.unique(codes[:, 0]):
                rows = np.flatnonzero(codes[:, 0] == y)
                out[of[:, None], :, rows] = edits_from_start([parts[p] for p in of], codes[rows], size[rows], letters,
                                                             low, high).transpose(0, 2, 1)
        return out
    return edits_from_start(parts, codes, size, letters, low, high)


def edits_from_start(parts: list[tuple], codes: np.ndarray, size: np.ndarray, letters: int, low: int, high: int) -> np.ndarray:
    out = np.full((len(parts), high - low + 1, len(size)), FAR, np.uint8)
    columns = np.ascontiguousarray(codes.T)
    start, sizes = 0, np.array([len(s) for s in parts])
    while start < min(sizes.min(), size.min()) and (columns[start] == parts[0][start]).all() and all(
            s[start] == parts[0][start] for s in parts):
        start += 1  # what all begin with is no edit
    for m in np.unique(sizes):
        of = np.flatnonzero(sizes == m)
        m -= start
        word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if m < 8 * np.dtype(w).itemsize)
        one, last = word(1), word(max(m - 1, 0))
        places = np.zeros((len(of), letters), word)
        for row, p in enumerate(of):
            for i, letter in enumerate(parts[p][start:]):
                places[row, letter] |= word(1 << i)
        step = max((1 << 17) // max(len(size), 1), 1)
        for at in range(0, len(of), step):
            some = of[at:at + step]
            vp, vn = np.full((len(some), len(size)), ~word(0)), np.zeros((len(some), len(size)), word)
            far = np.full(vp.shape, m, np.uint8)
            for k in range(min(m + high, codes.shape[1] - start) + 1):  # after k letters
                if k:
                    eq = places[at:at + step].take(columns[start + k - 1], axis=1)
                    d0 = (((eq & vp) + vp) ^ vp) | eq | vn
                    hp, hn = vn | ~(d0 | vp), d0 & vp
                    far += ((hp >> last) & one).astype(np.uint8)
                    far -= ((hn >> last) & one).astype(np.uint8)
                    hp = (hp << one) | one
                    vp, vn = (hn << one) | ~(d0 | hp), hp & d0
                if low <= k - m <= high:
                    out[some, k - m - low] = np.where(start + k <= size, far if m else k, FAR)
    return out


def met_in_parts(a: tuple[Names, Names], t: tuple[Names, Names], xn: np.ndarray, yn: np.ndarray, threshold: float) -> Iterator | None:
    """As ``met``, for names whose parts are few on the side of x; None if they are not."""
    (xa, ya), (xt, yt) = a, t
    kinds, number = np.unique(xn, return_inverse=True)
    (x_sizes, x_rare), (y_sizes, y_rare) = (common_sizes(a, t) for a, t in ((xa, xt), (ya, yt)))
    if not len(x_sizes) or not len(y_sizes):
        return None
    if (max(x_sizes.max(), y_sizes.max()) > LONGEST_IN_PARTS or max(len(x_sizes), len(y_sizes)) > MOST_SIZES
            or len(kinds) > MOST_COUNTS):
        return None
    in_parts = Parts(xa), Parts(xt)
    if not all(p.few(len(xn)) for p in in_parts):
        return None
    weights = ARTIST, TITLE
    most = int((1 - threshold) * UNIT + FINE * UNIT) + 1
    classes = [(s, own[np.argsort(in_parts[1].first[own], kind="stable")]) for s in x_sizes.tolist()
               for own in [np.flatnonzero((xa.size == s[0]) & (xt.size == s[1]))]]

    def slices() -> Iterator:
        for some, of in ((np.flatnonzero(x_rare), np.arange(len(yn))), (np.flatnonzero(~x_rare), np.flatnonzero(y_rare))):
            for i in some:
                if len(of):
                    yield np.full(len(of), i), of
        by_size = np.lexsort((yt.size, ya.size))
        by_size = by_size[~y_rare[by_size]]
        for at in range(0, len(by_size), SLICE):
            rows = by_size[at:at + SLICE]
            ys = ya.of(rows), yt.of(rows)
            steps = []
            for own, y, weight, shifts in zip(x_sizes.T, ys, weights, SHIFTS):
                allowed = int((1 - threshold) / weight * max(own.max(), y.size.max()) + FINE)
                by = np.subtract.outer(np.unique(y.size), own).ravel()
                by = by[np.abs(by) <= allowed]
                steps.append((min([0, *by]) - shifts, max([0, *by]) + shifts) if len(by) else None)
            if None in steps:
                continue
            tables = [p.tables(y, *step) for p, y, step in zip(in_parts, ys, steps)]
            ends = np.flatnonzero(np.diff(ys[0].size) | np.diff(ys[1].size)) + 1
            groups = list(zip([0, *ends], [*ends, len(rows)]))
            loss = ((1 - count_similarity(kinds[:, None], yn[rows])) * COUNT * UNIT).astype(np.uint16)
            for sizes, own in classes:
                for lo, hi in groups:
                    plan = planned(sizes, lo, ys, steps, most)
                    step = max((1 << 15) // (hi - lo), 1)
                    for at in range(0, len(own) if plan else 0, step):
                        some = own[at:at + step]
                        total = loss[number[some], lo:hi]
                        for p, (first, last), (cuts, cap, cost) in zip(in_parts, tables, plan):
                            edits = first[p.first[some], cuts, lo:hi]
                            edits += last[p.last[some], cuts, lo:hi][:, ::-1]
                            edits = edits.min(1)
                            np.minimum(edits, cap, out=edits)
                            total += np.multiply(edits, cost, dtype=np.uint16)
                        i, j = np.divmod(np.flatnonzero(total <= most), hi - lo)
                        if len(i):
                            yield some[i], rows[j + lo]

    def gathered() -> Iterator:
        i, j, n = [], [], 0
        for some, of in slices():
            i.append(some)
            j.append(of)
            n += len(of)
            if n >= CELLS:
                yield np.concatenate(i), np.concatenate(j), np.float32(ARTIST + COUNT)
                i, j, n = [], [], 0
        if n:
            yield np.concatenate(i), np.concatenate(j), np.float32(ARTIST + COUNT)
    return gathered()


def common_sizes(a: Names, t: Names) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of artist and title that many rows have, and the rows that have others."""
    sizes, number, n = np.unique(np.stack([a.size, t.size], 1), axis=0, return_inverse=True, return_counts=True)
    rare = n * RARE < len(a.size)
    return sizes[~rare], rare[number.ravel()]


def planned(sizes: list[int], lo: int, ys: tuple[Names, Names], steps: list, most: int) -> list | None:
    """For artists and titles of two sizes: rows of the tables that make up a pair (those of last parts in turned order), the
    edits that other cuts need, the loss of an edit; None if the sizes alone are too much."""
    out, least = [], 0
    for m, y, (low, high), weight, shifts in zip(sizes, ys, steps, (ARTIST, TITLE), SHIFTS):
        by = int(y.size[lo]) - m
        cost = int(weight * UNIT / max(m, int(y.size[lo])))
        least += abs(by) * cost
        if least > most:
            return None
        cuts = slice(min(0, by) - shifts - low, max(0, by) + shifts - low + 1)
        out.append((cuts, np.uint8(abs(by) + 2 * (shifts + 1)), np.uint16(cost)))
    return out


def met(xa: Names, xt: Names, xn: np.ndarray, ya: Names, yt: Names, yn: np.ndarray, threshold: float) -> Iterator:
    """Places (i, j) of all pairs at or above ``threshold`` and some others, slice by slice, and what artist and count
    add to their score at most."""
    kinds = np.unique(yn)
    if len(kinds) <= MOST_COUNTS:
        fn, gn = count_similarity(xn[:, None], kinds[None, :]), yn[:, None] == kinds[None, :]
    else:
        fn, gn = np.ones((len(xn), 1)), np.ones((len(yn), 1))
    fn, gn = fn.astype(np.float32), (gn * COUNT).astype(np.float32)
    ft, gt = letter_columns(xt, yt)

    def titles(rows: np.ndarray, left: np.ndarray, right: np.ndarray, of: np.ndarray, more: np.ndarray) -> Iterator:
        """Of rows with titles of one size: ``left`` by ``right`` and ``more`` are their pairs with the rows ``of`` y without titles."""
        weights = (gt[of] * (TITLE / np.maximum(yt.size[of], xt.size[rows[0]]))[:, None]).astype(np.float32).T
        step = max(CELLS // len(of), 1)
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            rest = left[some] @ right + more
            i, j = np.nonzero(ft[some] @ weights + rest >= threshold - ROUGH)
            yield some[i], of[j], rest[i, j]

    xd, yd = distinct(xa), distinct(ya)
    if len(xd[0]) * MANY_ROWS <= len(xn) and len(yd[0]) * MANY_ROWS <= len(yn):
        first, second = xa.of(xd[0]), ya.of(yd[0])
        p, q = (g.ravel() for g in np.indices((len(xd[0]), len(yd[0]))))
        apart = edits(first, second)(p, q) / np.maximum(first.size[p], second.size[q])
        alike = (ARTIST * (1 - apart)).reshape(len(xd[0]), -1).astype(np.float32)
        for k in range(len(xd[0])):
            of = np.flatnonzero(alike[k][yd[1]] >= threshold - TITLE - COUNT - ROUGH)
            if not len(of):
                continue
            own = np.flatnonzero(xd[1] == k)
            right, more = gn[of].T, alike[k][yd[1][of]]
            for size in np.unique(xt.size[own]):
                yield from titles(own[xt.size[own] == size], fn, right, of, more)
        return
    fa, ga = letter_columns(xa, ya)
    left, every = np.hstack([fa, fn]), np.arange(len(yn))
    sizes = np.stack([xa.size, xt.size], 1)
    for a_size, t_size in np.unique(sizes, axis=0):
        right = np.hstack([(ga * (ARTIST / np.maximum(ya.size, a_size))[:, None]).astype(np.float32), gn]).T
        yield from titles(np.flatnonzero((sizes == (a_size, t_size)).all(1)), left, right, every, np.float32(0))


def compare(threshold: float, carried: list[str], schema: pa.Schema) -> Callable:
    """The task of two blocks: rows of block ``u`` and of block ``v`` to pairs of rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        u, v, block = (table.column(c).to_numpy() for c in ("u", "v", "block"))
        x, y = np.flatnonzero(block == u), np.flatnonzero(block == v)
        if not len(x) or not len(y):
            return
        n = table.column("n").to_numpy()
        xs, ys = table.take(pa.array(x)), table.take(pa.array(y))
        (xa, ya), (xt, yt) = (numbered(xs.column(c).to_pylist(), ys.column(c).to_pylist()) for c in ("a", "t"))

        def able(a1: Names, t1: Names, a2: Names, t2: Names) -> np.ndarray:
            return np.flatnonzero(ARTIST * shared_at_most(a1, a2) + TITLE * shared_at_most(t1, t2)
                                  + COUNT >= threshold - FINE)
        keep = able(xa, xt, ya, yt)
        x, xa, xt = x[keep], xa.of(keep), xt.of(keep)
        if not len(x):
            return
        keep = able(ya, yt, xa, xt)
        y, ya, yt = y[keep], ya.of(keep), yt.of(keep)
        if not len(y):
            return
        xn, yn = n[x], n[y]
        titles_apart, artists_apart = edits(xt, yt), edits(xa, ya)
        found = met_in_parts((xa, ya), (xt, yt), xn, yn, threshold) or met(xa, xt, xn, ya, yt, yn, threshold)
        for i, j, rest in found:
            if u[0] == v[0]:
                once = x[i] < y[j]
                i, j, rest = i[once], j[once], rest if rest.ndim == 0 else rest[once]
            title = TITLE * (1 - titles_apart(i, j) / np.maximum(xt.size[i], yt.size[j]))
            near = title + rest >= threshold - ROUGH
            i, j, title = i[near], j[near], title[near]
            artist = ARTIST * (1 - artists_apart(i, j) / np.maximum(xa.size[i], ya.size[j]))
            near = artist + title + COUNT * count_similarity(xn[i], yn[j]) >= threshold - FINE
            i, j = i[near], j[near]
            for at in range(0, len(i), BATCH):
                sides = [table.take(pa.array(rows[at:at + BATCH])) for rows in (x[i], y[j])]
                out = pa.table([side.column(c) for side in sides for c in carried], schema=schema)
                yield from out.combine_chunks().to_batches()
    return task


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each letter, folded, and its size."""
    letters, size = spelled(texts)
    counts = np.zeros((len(size), FOLDED), np.int16)
    for i in range(letters.shape[1]):
        rows = np.flatnonzero(size > i)
        counts[rows, letters[rows, i] % FOLDED] += 1
    return counts, size


def letters_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of a block have of each letter at most, and the size of the shortest name, batch by batch."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        for name in ("a", "t"):
            counts, size = folded(batch.column(name).to_pylist())
            for b in np.unique(block):
                most = counts[block == b].max(0)
                letters = np.flatnonzero(most)
                n = len(letters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b, np.int32)), pa.array([name] * n, pa.string()), pa.array(letters.astype(np.int32)),
                     pa.array(most[letters].astype(np.int32)), pa.array(np.full(n, size[block == b].min(), np.int32))],
                    names=["block", "name", "letter", "most", "least"])


def dealt(most: dict, least: dict, threshold: float, schema: pa.Schema) -> Callable:
    """Rows to the groups (u, v) of two blocks in which they may have a partner."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            own = batch.column("block").to_numpy().astype(np.int32)
            names = {}
            for c in ("a", "t"):
                counts, size = folded(batch.column(c).to_pylist())
                letters = np.flatnonzero(counts.any(0))
                names[c] = counts[:, letters], size, most[c][:, letters]
            for other in range(len(least["a"])):
                shared = {c: np.minimum(1.0, np.minimum(counts, of[other]).sum(1) / np.maximum(size, least[c][other]))
                          for c, (counts, size, of) in names.items()}
                keep = np.flatnonzero(ARTIST * shared["a"] + TITLE * shared["t"] + COUNT >= threshold - FINE)
                if len(keep):
                    u, v = np.minimum(own[keep], other), np.maximum(own[keep], other)
                    out = table.take(pa.array(keep)).append_column("u", pa.array(u, pa.int32())).append_column(
                        "v", pa.array(v, pa.int32()))
                    yield from out.select(schema.names).cast(schema).combine_chunks().to_batches()
    return task


def units(blocks: DataFrame, count: int, threshold: float) -> DataFrame:
    """The rows of the written ``blocks(a, t, block, ...)`` with the groups (u, v) of two of ``count`` blocks that they go to."""
    told = (blocks.select("a", "t", "block")
            .mapInArrow(letters_of_blocks, "block int, name string, letter int, most int, least int")
            .groupBy("block", "name", "letter").agg(F.max("most").alias("most"), F.min("least").alias("least")).collect())
    most = {c: np.zeros((count, FOLDED), np.int16) for c in ("a", "t")}
    least = {c: np.full(count, np.iinfo(np.int32).max) for c in ("a", "t")}
    for r in told:  # at most a row for each block, name and folded letter
        most[r["name"]][r["block"], r["letter"]] = r["most"]
        least[r["name"]][r["block"]] = min(least[r["name"]][r["block"]], r["least"])
    schema = StructType([*blocks.schema.fields, StructField("u", IntegerType()), StructField("v", IntegerType())])
    return blocks.mapInArrow(dealt(most, least, threshold, to_arrow_schema(schema)), schema)


def pairs(rows: DataFrame, total: int, threshold: float) -> DataFrame:
    """Every two of the ``total`` distinct ``rows(a, t, n, ...)`` at or above ``threshold``, once, as columns c1, c2 and similarity."""
    carried = rows.columns
    count = max(-(-total // BLOCK), min(BLOCKS, total), 1)
    few = rows.select("a").distinct().count() * MANY_ROWS <= total
    order = ("a", "t", "n") if few else ("t", "a", "n")
    blocks = materialize(rows.repartitionByRange(count, *order).withColumn("block", F.spark_partition_id()), "blocks")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * cores, min(count * (count + 1) // 2, MOST_PARTS))  # few bytes, but many pairs to compare
    dealt_out = units(blocks, count, threshold).repartition(parts, "u", "v")
    schema = StructType([StructField(f"{f.name}{side}", f.dataType) for side in (1, 2) for f in rows.schema.fields])
    found = dealt_out.groupBy("u", "v").applyInArrow(compare(threshold, carried, to_arrow_schema(schema)), schema)

    def alike(x: str, y: str, weight: float) -> tuple:
        longest = F.greatest(F.length(x), F.length(y))
        most = F.floor(longest * min((1.0 - threshold) / weight, 1.0) + FINE).cast("int")
        return F.call_function("levenshtein", F.col(x), F.col(y), most), F.greatest(longest, F.lit(1)).cast("double")
    (ea, la), (et, lt) = alike("a1", "a2", ARTIST), alike("t1", "t2", TITLE)
    score = tx.weighted_similarity(1 - F.col("ea").cast("double") / la, 1 - F.col("et").cast("double") / lt,
                                   tx.count_similarity("n1", "n2"))
    return (found.withColumn("ea", ea).withColumn("et", et).where("ea >= 0 AND et >= 0")
            .withColumn("similarity", score).drop("ea", "et").where(F.col("similarity") >= threshold))
