"""How much the completions of one prompt differ."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Python workers need no copy of this package: the functions below travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Samples in one probe, and the mean distance below which diversity is low.
PROBE_SIZE = 5
LOW_DIVERSITY = 50.0
# Different texts in a block of the exact mean, and letters of a text up to which a block is not made smaller.
TILE = 1024
TILE_LETTERS = 256
# A block is so many times as large if so many texts or more begin and end alike, and have like lengths: these are compared faster.
ALIKE_TILES = 16
ALIKE_TEXTS = 64
ALIKE_ENDS = 8
# Texts of a block that share all but so many letters, and so many of them at least, are compared by these letters alone.
FRAME_WIDTH = 16
FRAME_TEXTS = 32
# So few texts that share nothing with others are each compared with all of a frame at once.
SINGLE_TEXTS = 8
# Other texts of up to so many letters are compared a bit a pair too, if there are so many, with so many others at once.
BIT_LETTERS = 512
BIT_TEXTS = 48
BIT_BLOCK = 1024
BIT_BYTES = 1 << 25
# Bytes of a bit for each pair whose middles are compared at once, and pairs whose distances are held at once.
BLOCK_BYTES = 1 << 16
BLOCK_PAIRS = 1 << 17
# Words of 64 bits that the kept columns of one table of distances take.
KEPT_WORDS = 1 << 21
_TOP = np.uint64(63)
_ONE = np.uint64(1)


def distance_sums(rows: list[str], others: list[str], weights: np.ndarray) -> Iterator[int]:
    """For each of ``others``: the weighted sum of its edit distances to all ``rows``.

    A bit-vector recurrence (Myers 1999, in words as by Hyyro 2003): the column of differences of a row's table is held in bits, 64
    letters to a word, and one step by a letter serves all rows at once.  Neighbours in ``others`` that begin alike share the
    steps of that beginning, so sorted ones cost least; the result does not depend on the order.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in rows]
    lengths = np.array([len(c) for c in codes], np.int64)
    words = max(1, -(-int(lengths.max(initial=0)) // 64))
    # equal letters by word and row; a letter that no row has equals nothing
    where = np.repeat(np.arange(len(rows)), lengths)
    at = np.concatenate([np.arange(n) for n in lengths]) if len(rows) else np.empty(0, np.int64)
    letters, kind = np.unique(np.concatenate(codes) if len(rows) else np.empty(0, "<u4"), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(len(letters) + 1))
    places = {int(c): order[ends[k] : ends[k + 1]] for k, c in enumerate(letters)}
    none = np.zeros((words, len(rows)), np.uint64)
    known: dict[int, np.ndarray] = {}
    room = max(1, KEPT_WORDS // max(1, none.size))

    def equal(letter: int) -> np.ndarray:
        found = known.get(letter)
        if found is None:
            found = none
            if letter in places:
                found, p = none.copy(), places[letter]
                np.bitwise_or.at(found, (at[p] // 64, where[p]), _ONE << (at[p] % 64).astype(np.uint64))
            if len(known) >= room:
                known.clear()
            known[letter] = found
        return found

    masks = np.zeros_like(none)
    for w in range(words):
        bits = np.clip(lengths - 64 * w, 0, 64)
        masks[w] = np.where(bits > 0, ~np.uint64(0) >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
    kept = [(np.full_like(none, ~np.uint64(0)), none)]
    before: list[int] = []
    for text in others:
        letters_of = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").tolist()
        same = 0
        for x, y in zip(before[: len(kept) - 1], letters_of):
            if x != y:
                break
            same += 1
        del kept[same + 1 :]
        up, down = kept[same]
        for i in range(same, len(letters_of)):
            up, down = _step(up, down, equal(letters_of[i]))
            if len(kept) == i + 1 and i < room:
                kept.append((up, down))
        before = letters_of
        distance = len(letters_of) + (np.bitwise_count(up & masks).astype(np.int64) - np.bitwise_count(down & masks)).sum(axis=0)
        yield int(distance @ weights)


def _step(up: np.ndarray, down: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next column of all tables: where it rises and where it falls from letter to letter."""
    new_up, new_down = np.empty_like(up), np.empty_like(down)
    plus, minus = _ONE, np.uint64(0)  # the first line of a table rises by one in each column
    for w in range(len(up)):
        p, m, e = up[w], down[w], equal[w]
        vertical = e | m
        e = e | minus
        level = (((e & p) + p) ^ p) | e
        rises, falls = m | ~(level | p), p & level
        next_plus, next_minus = rises >> _TOP, falls >> _TOP
        rises, falls = (rises << _ONE) | plus, (falls << _ONE) | minus
        new_up[w] = falls | ~(vertical | rises)
        new_down[w] = rises & vertical
        plus, minus = next_plus, next_minus
    return new_up, new_down


class Frame:
    """Texts that begin and end alike: the letters they share in front and behind, and those between, in groups of like length.

    Letters are numbers; a group has a line for each letter and a column for each text, and the counts of its texts.
    """

    def __init__(self, head: np.ndarray, tail: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.head, self.tail, self.groups = head, tail, groups


def build_frames(found: list[tuple[list[str], np.ndarray, int, int]]) -> list[Frame]:
    """Frames of texts with their counts and the numbers of letters shared in front and behind; equal letters have one number in all."""
    pieces, shapes = [], []
    for texts, counts, head, tail in found:
        middles = [t[head : len(t) - tail] for t in texts]
        lengths = np.array([len(m) for m in middles])
        groups = [(k, np.flatnonzero(lengths == k)) for k in np.unique(lengths).tolist()]
        pieces += [texts[0][:head], texts[0][len(texts[0]) - tail :]] + ["".join([middles[i] for i in alike]) for _, alike in groups]
        shapes.append([(k, counts[alike]) for k, alike in groups])
    codes = iter(_codes(pieces))
    frames = []
    for groups in shapes:
        head, tail = next(codes), next(codes)
        frames.append(Frame(head, tail, [(np.ascontiguousarray(next(codes).reshape(len(c), k).T), c) for k, c in groups]))
    return frames


def find_frames(texts: list[str], width: int = FRAME_WIDTH, least: int = FRAME_TEXTS) -> tuple[list[tuple[list[int], int, int]], list[int]]:
    """Different texts in groups that share all but at most ``width`` letters, with the letters shared in front and behind; and the rest.

    A group that differs in more is divided by the first letter that differs from the front, or from behind, whichever gives fewer parts;
    parts of less than ``least`` texts are left to the rest.
    """
    found, rest, open_groups = [], [], [list(range(len(texts)))]
    behind = [t[::-1] for t in texts]
    while open_groups:
        group = open_groups.pop()
        if len(group) < least:
            rest += group
            continue
        lengths = [len(texts[i]) for i in group]
        head = _alike(min(texts[i] for i in group), max(texts[i] for i in group))
        tail = min(_alike(min(behind[i] for i in group), max(behind[i] for i in group)), min(lengths) - head)
        if max(lengths) - head - tail <= width:
            found.append((group, head, tail))
            continue
        ways: tuple[dict[str, list[int]], dict[str, list[int]]] = {}, {}
        for i, n in zip(group, lengths):
            more = n > head + tail
            ways[0].setdefault(texts[i][head] if more else "", []).append(i)
            ways[1].setdefault(behind[i][tail] if more else "", []).append(i)
        open_groups += min(ways, key=len).values()
    return found, rest


def _alike(first: str, second: str) -> int:
    """Letters that two texts share in front."""
    low, high = 0, min(len(first), len(second))
    while low < high:
        half = (low + high + 1) // 2
        if first[low:half] == second[low:half]:
            low = half
        else:
            high = half - 1
    return low


def _codes(texts: list[str]) -> list[np.ndarray]:
    """The letters of texts as small numbers, the same for equal letters of all texts."""
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.zeros(int(whole.max(initial=0)) + 1, np.uint32)
    number[whole] = 1
    kinds = int(number.sum())
    number = (np.cumsum(number, dtype=np.uint32) - number).astype(np.uint8 if kinds <= 256 else np.uint32)
    return np.split(number[whole], np.cumsum([len(t) for t in texts])[:-1])


def _grown(row: np.ndarray, letters: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of distances whose last rows are ``row``, grown by a row for each of ``letters``: what the last column gains, and the last row."""
    steps = np.arange(row.shape[1])
    ends = [row[:, -1]]
    for letter in letters:
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (columns != letter[:, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        ends.append(row[:, -1])
    return np.array(ends), row


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different column is found first, and which of them every column is."""
    if not len(columns) or (columns == columns[:, :1]).all():
        return np.zeros(1, np.int64), np.zeros(columns.shape[1], np.int64)
    _, first, which = np.unique(columns, axis=1, return_index=True, return_inverse=True)
    return first, which.ravel()


class _Side:
    """Distances of the texts of a group to what another frame shares, once for all texts that meet it alike.

    ``edge``: after each letter of the middle, to all that is shared.  ``row``: after the middle, to every beginning of it.
    """

    def __init__(self, row: np.ndarray, letters: np.ndarray, columns: np.ndarray) -> None:
        # letters that the columns lack are all the same to them
        first, self.which = _distinct(np.where(np.isin(letters, columns), letters.astype(np.int64) + 1, 0))
        self.edge, self.row = _grown(np.repeat(row[None], len(first), axis=0), letters[:, first], columns)


def frame_sum(a: Frame, b: Frame) -> int:
    """Weighted sum of the edit distances of all texts of ``a`` to all of ``b``; of a frame and itself, each pair once.

    In the table of two texts only the block where their middles meet depends on the pair.  What enters it over its upper and left edge,
    and what is left to do from its lower and right edge, depends on one text and the other's frame.  A way that passes by crosses
    the column of the right edge above the block or the row of the lower edge before it: the sum of a number of either text.
    """
    if a is b:
        return sum(_block_sum(g, h, same=g is h) for k, g in enumerate(a.groups) for h in a.groups[k:])
    front, back = _shared(a.head, b.head), _shared(a.tail[::-1], b.tail[::-1])
    heads = a.head[front:], b.head[front:]
    tails = a.tail[::-1][back:], b.tail[::-1][back:]  # read from behind
    if not any(len(part) for part in (*heads, *tails)):
        return sum(_block_sum(g, h) for g in a.groups for h in b.groups)
    left, top = _corner(*heads)
    right, bottom = _corner(*tails)
    of_a = _ways(a, (top, bottom), (heads[0], heads[1]), tails[1])
    of_b = _ways(b, (left, right), (heads[1], heads[0]), tails[0])
    total = 0
    for g, (into_x, out_x, before_x, after_x) in zip(a.groups, of_a):
        for h, (into_y, out_y, before_y, after_y) in zip(b.groups, of_b):
            total += _block_sum(g, h, (into_x, into_y), (out_x, out_y), ((after_x, before_y), (before_x, after_y)))
    return total


def _ways(frame: Frame, corner: tuple[np.ndarray, np.ndarray], heads: tuple[np.ndarray, np.ndarray], tail: np.ndarray) -> list[tuple]:
    """For each group of a frame: the ways to and from the edge of the block, and past it, with the frame's own and the other's head and the other's tail."""
    sides = [(_Side(corner[0], x, heads[1]), _Side(corner[1], x[::-1], tail)) for x, _ in frame.groups]
    # once for all groups: the way from the column of the edge above the block
    rows = np.concatenate([out.row for _, out in sides])
    first, which = _distinct(rows.T)
    ends, _ = _grown(rows[first], np.repeat(heads[0][::-1, None], len(first), axis=1), tail)
    found, start = [], 0
    for into, out in sides:
        own, at = np.unique(which[start : start + len(out.row)][out.which], return_inverse=True)
        start += len(out.row)
        found.append((into.edge[:, into.which], out.edge[::-1, out.which], (into.row.T, into.which), (ends[::-1, own], at)))
    return found


def _shared(first: np.ndarray, second: np.ndarray) -> int:
    n = min(len(first), len(second))
    unlike = np.flatnonzero(first[:n] != second[:n])
    return int(unlike[0]) if len(unlike) else n


def _corner(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last column and last row of the table of two texts."""
    ends, row = _grown(np.arange(len(columns) + 1)[None], rows[:, None], columns)
    return ends[:, 0], row[0]


def _block_sum(g: tuple, h: tuple, into: tuple | None = None, out: tuple | None = None, ways: tuple = (), same: bool = False) -> int:
    """Weighted sum of the distances of all texts of two groups; of a group and itself, each pair once.

    ``into`` and ``out`` hold the way to and from each edge of the block, ``ways`` those that pass by.  A pair is one bit in the words of
    :func:`_edges`.
    """
    (x, of_x), (y, of_y) = g, h
    (wide, n), (high, m) = x.shape, y.shape
    if n < m:
        return _block_sum(h, g, into and into[::-1], out and out[::-1], tuple((q, p) for p, q in ways))
    into_x, into_y = into or (np.repeat(np.arange(wide + 1)[:, None], n, axis=1), np.repeat(np.arange(high + 1)[:, None], m, axis=1))
    ends = _Ends(into_x, into_y, out, ways) if out else None
    steps = np.diff(into_x, axis=0)
    left = _packed(steps > 0), _packed(steps < 0)
    tops = np.diff(into_y, axis=0)
    planes = [_packed((of_x >> k & 1)[None].astype(bool))[0] for k in range(int(of_x.max()).bit_length())]
    words = left[0].shape[1]
    step = max(1, BLOCK_BYTES // (8 * words))
    step = -(-step // 64) * 64 if same else step  # squares begin with a word
    total = 0
    for start in range(0, m, step):
        rows, skip = slice(start, min(m, start + step)), start // 64 if same else 0
        if ends and not ends.through:
            right, lower = [], []
        else:
            right, lower = _edges(x[:, 64 * skip :], y[:, rows], (left[0][:, skip:], left[1][:, skip:]), tops[:, rows])
        mine = of_y[rows].tolist()
        if ends:
            total += ends.sum(right, lower, rows, of_x, mine)
            continue
        begin = sum(c * e for c, e in zip(mine, into_y[-1, rows].tolist()))
        found, square = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        for k, plane in enumerate(planes):
            gain = np.zeros(right[0][0].shape if right else (len(mine), words - skip), np.int16)
            for up, down in right:
                gain += np.bitwise_count(up & plane[skip:])
                gain -= np.bitwise_count(down & plane[skip:])
            found += gain.sum(axis=1, dtype=np.int64) << k
            square += gain[:, : -(-len(mine) // 64)].sum(axis=1, dtype=np.int64) << k
        total += begin * int(of_x[64 * skip :].sum()) + sum(c * s for c, s in zip(mine, found.tolist()))
        if same:
            # pairs of these rows are there twice
            total -= (begin * int(of_x[rows].sum()) + sum(c * s for c, s in zip(mine, square.tolist()))) // 2
    return total


def _packed(bits: np.ndarray) -> np.ndarray:
    """Lines of bits in words of 64, the first lowest."""
    n = bits.shape[1]
    out = np.zeros((len(bits), -(-n // 64) * 8), np.uint8)
    out[:, : -(-n // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view(np.uint64)


def _edges(x: np.ndarray, y: np.ndarray, left: tuple[np.ndarray, np.ndarray], tops: np.ndarray) -> tuple[list, list]:
    """How the table rises and falls by one along the right edge of the block, and along the lower one, for all pairs at once.

    The bit-vector recurrence with the bits of a word dealt to 64 pairs, so that none waits for another: one step for each two letters.
    """
    words, m = left[0].shape[1], y.shape[1]
    letters, kind = np.unique(y, return_inverse=True)
    kind = kind.reshape(y.shape)
    equal = [_packed(letters[:, None] == line) for line in x]
    ups, downs = ([np.repeat(line[None], m, axis=0) for line in side] for side in left)
    spare = [np.empty((m, words), np.uint64) for _ in range(3)]
    lower, none, full = [], np.uint64(0), ~np.uint64(0)
    for j, top in enumerate(tops):
        rises, falls = (np.repeat(np.where(side, full, none)[:, None], words, axis=1) for side in (top > 0, top < 0))
        _column(ups, downs, equal, kind[j], rises, falls, spare)
        lower.append((rises, falls))
    return list(zip(ups, downs)), lower


def _column(ups: list, downs: list, equal: list, kind: np.ndarray, rises: np.ndarray, falls: np.ndarray, spare: list) -> None:
    """The next column of all tables: where it rises and falls from row to row, and last from this column to the next, all in place."""
    match, vertical, level = spare
    for i, (up, down) in enumerate(zip(ups, downs)):
        equal[i].take(kind, 0, match, "clip")
        np.bitwise_or(match, down, out=vertical)
        np.bitwise_or(match, falls, out=level)
        # the next column's rise and fall
        np.bitwise_or(vertical, rises, out=match)
        np.invert(match, out=match)
        np.bitwise_or(match, falls, out=match)
        np.bitwise_and(vertical, rises, out=vertical)
        # what the next row meets
        np.bitwise_and(up, level, out=falls)
        np.bitwise_or(level, up, out=rises)
        np.invert(rises, out=rises)
        np.bitwise_or(rises, down, out=rises)
        ups[i], downs[i], match, vertical = match, vertical, up, down
    spare[:] = match, vertical, level


class _Ends:
    """The shortest of all ways, for pairs of two groups of different frames.

    What a pair's ways take is held in a byte, as what it is less than ``ceiling``; ways that others undercut for all pairs are left out.
    """

    def __init__(self, into_x: np.ndarray, into_y: np.ndarray, out: tuple[np.ndarray, np.ndarray], ways: tuple) -> None:
        out_x, out_y = out
        wide, high = len(out_x) - 1, len(out_y) - 1
        self.corner, self.span = int(into_x[0, 0]), wide + high
        spare, direct = self.span + max(wide, high), self.corner + int(out_x[-1, 0])
        # what ways take at least and at most, over all pairs
        least = [[p + q for p, q in zip(s[0].min(axis=1).tolist(), t[0].min(axis=1).tolist())] for s, t in ways]
        most = [p + q for s, t in ways for p, q in zip(s[0].max(axis=1).tolist(), t[0].max(axis=1).tolist())]
        floor = min(direct + spare, *most)
        self.ceiling, self.through, self.passing = floor + 2 * spare, direct - spare <= floor, []
        for (s, t), low in zip(ways, least):
            kept = np.array(low) <= floor
            of_x, of_y = s[0][kept].astype(np.uint8), (self.ceiling - t[0][kept]).astype(np.uint8)
            table = None
            if of_x.shape[1] * of_y.shape[1] <= BLOCK_PAIRS:
                table = np.zeros((of_y.shape[1], of_x.shape[1]), np.uint8)
                for mine, other in zip(of_x, of_y):
                    np.maximum(table, other[:, None] - mine, out=table)
            self.passing.append((table, of_x, of_y, s[1], t[1]))
        # held along an edge: what lies above the corner's distance less ``span``
        first = self.corner - self.span
        self.x, self.y = (into_x[-1] - first).astype(np.uint8), (into_y[-1] - first).astype(np.uint8)
        self.add_x, self.add_y = (self.ceiling - first - out_x).astype(np.uint8), (self.ceiling - first - out_y).astype(np.uint8)
        self.right, self.lower = _leaving(out_x), _leaving(out_y)
        # both edges end in one corner: it is met once, on the edge that is followed anyway
        if wide and high and wide in self.right + [wide] * (high in self.lower):
            self.right, self.lower = [i for i in self.right if i < wide], [j for j in self.lower if j < high]
            (self.lower if self.lower or not self.right else self.right).append(high if self.lower or not self.right else wide)

    def sum(self, right: list, lower: list, rows: slice, weights: np.ndarray, counts: list[int]) -> int:
        """Weighted sum of the distances of the rows to all."""
        n, total, most = len(weights), 0, self.ceiling * int(weights.sum())
        # whole numbers that these types hold, as long as there are less than 2 ** 45 samples
        kind = np.float32 if 255 * int(weights.sum()) < 1 << 24 else np.float64
        weights, size = weights.astype(kind), max(1, BLOCK_PAIRS // n)
        for begin in range(0, len(counts), size):
            part = slice(begin, min(begin + size, len(counts)))
            place = slice(rows.start + part.start, rows.start + part.stop)
            shape = (part.stop - part.start, n)
            single = [table[at_y[place], 0] for table, _, _, _, at_y in self.passing if table is not None and table.shape[1] == 1]
            best = _filled(single, shape)
            for table, of_x, of_y, at_x, at_y in self.passing:
                if table is None:
                    for mine, other in zip(of_x, of_y):
                        np.maximum(best, other[at_y[place], None] - mine[at_x], out=best)
                elif table.shape[1] > 1:
                    np.maximum(best, table[at_y[place]].take(at_x, 1), out=best)
            if self.through and self.right:
                held, left = _filled([self.y[place]], shape), np.empty(shape, np.uint8)
                for i, (up, down) in enumerate(right[: self.right[-1]], 1):
                    held += _unpacked(up[part], n)
                    held -= _unpacked(down[part], n)
                    if i in self.right:
                        np.maximum(best, np.subtract(self.add_x[i], held, out=left), out=best)
            if self.through and self.lower:
                held, left = np.repeat(self.x[None], shape[0], axis=0), np.empty(shape, np.uint8)
                for j, (up, down) in enumerate(lower[: self.lower[-1]], 1):
                    held += _unpacked(up[part], n)
                    held -= _unpacked(down[part], n)
                    if j in self.lower:
                        np.maximum(best, np.subtract(self.add_y[j, place, None], held, out=left), out=best)
            total += sum(c * (most - int(s)) for c, s in zip(counts[part], (best.astype(kind) @ weights).tolist()))
        return total


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=1, count=n, bitorder="little")


def _leaving(out: np.ndarray) -> list[int]:
    """Places on an edge, but the first, from which a way may be shorter than over a place beside it, for some text.

    A step along the edge takes one at most, so a place is not needed if the way from the one beside is always shorter.
    """
    steps = np.diff(out, axis=0)
    less, more = [*(steps.max(axis=1) < 0).tolist(), False], (steps.min(axis=1) > 0).tolist()
    return [k for k in range(1, len(out)) if not less[k] and not more[k - 1]]


def _filled(lines: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Bytes whose rows hold the largest of each line's values, none: 0."""
    line = np.maximum.reduce(lines) if lines else np.zeros(1, np.uint8)
    if (line == line[0]).all():
        return np.full(shape, line[0], np.uint8)
    return np.repeat(line[:, None], shape[1], axis=1)


def _tile_sums(tiles: pa.Table) -> pa.Table:
    """Sum of the weighted distances of all pairs of a tile; in a tile of a block with itself every pair counts once."""
    first = tiles["_first"].to_numpy(zero_copy_only=False).astype(bool)
    texts, counts = tiles["text"].to_pylist(), tiles["_c"].to_numpy().astype(np.int64)
    inside = tiles["_i"][0].as_py() == tiles["_j"][0].as_py()
    mine, others = np.flatnonzero(first).tolist(), np.flatnonzero(~first).tolist()
    (found, rest), (other_found, other_rest) = _framed(mine, texts), _framed(others, texts)
    frames = build_frames([([texts[i] for i in group], counts[group], head, tail) for group, head, tail in found + other_found])
    frames, other_frames = frames[: len(found)], frames[len(found) :]
    if inside:
        total = sum(frame_sum(a, b) for k, a in enumerate(frames) for b in frames[k:])
        total += _cross_sum(sorted(set(mine).difference(rest)), rest, texts, counts) + _cross_sum(rest, rest, texts, counts) // 2
    else:
        total = sum(frame_sum(a, b) for a in frames for b in other_frames)
        total += _cross_sum(rest, others, texts, counts) + _cross_sum(sorted(set(mine).difference(rest)), other_rest, texts, counts)
    return pa.table({"prompt_id": tiles["prompt_id"].slice(0, 1), "_n": tiles["_n"].slice(0, 1), "_total": pa.array([total], pa.int64())})


def _framed(mine: list[int], texts: list[str]) -> tuple[list[tuple[list[int], int, int]], list[int]]:
    """The frames of a block, and the texts in none; a few such texts are frames of their own if there are others."""
    found, rest = find_frames([texts[i] for i in mine])
    found, rest = [([mine[k] for k in group], head, tail) for group, head, tail in found], [mine[k] for k in rest]
    if found and len(rest) <= SINGLE_TEXTS:
        found, rest = found + [([i], len(texts[i]), 0) for i in rest], []
    return found, rest


def _cross_sum(some: list[int], others: list[int], texts: list[str], counts: np.ndarray) -> int:
    """Weighted sum of the distances of each text of one list to each of the other; the longer one is taken at once."""
    some, others = sorted((some, others), key=len)
    short, short_others = ([i for i in part if len(texts[i]) <= BIT_LETTERS] for part in (some, others))
    if len(short) < BIT_TEXTS or not short_others:
        return _long_sum(some, others, texts, counts)
    long, long_others = ([i for i in part if len(texts[i]) > BIT_LETTERS] for part in (some, others))
    total = bit_sum(*([texts[i] for i in part] for part in (short, short_others)), *(counts[part] for part in (short, short_others)))
    return total + _long_sum(long, others, texts, counts) + _long_sum(short, long_others, texts, counts)


def _long_sum(some: list[int], others: list[int], texts: list[str], counts: np.ndarray) -> int:
    """As :func:`_cross_sum`, for few or long texts."""
    some, others = sorted((some, others), key=len)
    some = sorted(some, key=lambda i: texts[i])
    total = 0
    # rows of like length together, and no more at once than their tables may take
    for part in _parts(sorted(others, key=lambda i: len(texts[i])), texts) if some else ():
        sums = distance_sums([texts[i] for i in part], [texts[i] for i in some], counts[part])
        total += sum(s * int(counts[i]) for i, s in zip(some, sums))
    return total


def bit_sum(some: list[str], others: list[str], of_some: np.ndarray, of_others: np.ndarray) -> int:
    """Weighted sum of the distances of each text to each of the others, a bit a pair, as in :func:`_edges`: for many short texts.

    A row below the end of a text, or a column behind it, does not touch those before, so texts of any length go together: those that end
    at a column are summed there and left out from then on.
    """
    codes = _codes(some + others)
    numbers = codes[: len(some)], codes[len(some) :]
    y_order, x_order = (sorted(range(len(part)), key=lambda k: -len(part[k])) for part in numbers)
    # where each letter stands is held for each place of a text
    room = BIT_BYTES // (8 * max(len(c) for c in numbers[1]) * (1 + max(int(c.max(initial=0)) for c in codes)) or 1)
    size = min(BIT_BLOCK, 64 * max(1, room))
    total = 0
    for begin in range(0, len(x_order), size):
        part = x_order[begin : begin + size]
        x, x_sizes = _padded([numbers[1][k] for k in part])
        of_x = of_others[part]
        wide, words = len(x), -(-len(part) // 64)
        inside = [x_sizes > i for i in range(wide)]
        planes = [[_packed((of_x >> k & 1)[None].astype(bool) & row)[0] for row in inside] for k in range(int(of_x.max()).bit_length())]
        step = max(BIT_TEXTS, BLOCK_BYTES // (8 * words))
        for start in range(0, len(y_order), step):
            chunk = y_order[start : start + step]
            y, y_sizes = _padded([numbers[0][k] for k in chunk])
            letters, kind = np.unique(y, return_inverse=True)
            kind = kind.reshape(y.shape)
            equal = [_packed(letters[:, None] == row) for row in x]
            ups = [np.full((len(chunk), words), ~np.uint64(0)) for _ in range(wide)]
            downs = [np.zeros((len(chunk), words), np.uint64) for _ in range(wide)]
            spare = [np.empty((len(chunk), words), np.uint64) for _ in range(3)]
            weighed = np.zeros(len(chunk), object)
            active = len(chunk)
            for j in range(len(y) + 1):
                if j:
                    rises, falls = np.full((active, words), ~np.uint64(0)), np.zeros((active, words), np.uint64)
                    _column(ups, downs, equal, kind[j - 1, :active], rises, falls, spare)
                left = int((y_sizes > j).sum())
                if left < active:
                    ended = slice(left, active)
                    for k, plane in enumerate(planes):
                        gain = np.zeros((active - left, words), np.int32)
                        for up, down, row in zip(ups, downs, plane):
                            gain += np.bitwise_count(up[ended] & row)
                            gain -= np.bitwise_count(down[ended] & row)
                        weighed[ended] += gain.sum(axis=1, dtype=np.int64) << k
                    active = left
                    ups, downs, spare = ([a[:active] for a in arrays] for arrays in (ups, downs, spare))
            samples = int(of_x.sum())
            total += sum(int(c) * (int(n) * samples + int(w)) for c, n, w in zip(of_some[chunk], y_sizes, weighed))
    return total


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as columns, filled up with any letter, and their lengths."""
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((len(codes), int(sizes.max())), codes[0].dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(codes)
    return np.ascontiguousarray(out.T), sizes


def _parts(mine: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Rows in order of length, cut so that words times rows stay small."""
    part: list[int] = []
    for i in mine:
        if part and (len(part) + 1) * (len(texts[i]) // 64 + 1) > KEPT_WORDS // 64:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def exact_diversity(completions: DataFrame, block: int = TILE, low: float = LOW_DIVERSITY) -> DataFrame:
    """Mean edit distance over *all* pairs of completions of each prompt: one row per prompt.

    Equal texts of a prompt become one with a count.  The different ones are dealt to blocks of about ``block`` by a hash, larger ones if many
    begin and end alike.  Pairs form a triangle of tiles, block against block; a text is sent to one tile for each block, and a tile holds
    two blocks and puts out one sum: of texts that begin and end alike by what lies between (:func:`frame_sum`), of others by all
    letters (:func:`bit_sum`, :func:`distance_sums`).  No pair becomes a row, and no task holds a prompt of more texts than a block.  The work still grows with
    the square of a prompt's different texts; for estimates that grow with the samples only, see :func:`completion_diversity`.
    """
    text = F.col("text")
    counted = completions.groupBy("prompt_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("_c"))
    ends = F.struct(F.left(text, F.lit(ALIKE_ENDS)), F.right(text, F.lit(ALIKE_ENDS)), F.floor(F.length(text) / FRAME_WIDTH))
    sizes = counted.groupBy("prompt_id").agg(
        F.sum("_c").alias("_n"), F.count("*").alias("_kinds"), F.sum(F.length(text)).alias("_letters"), F.approx_count_distinct(F.xxhash64(ends)).alias("_ends")
    )
    tile = F.when(F.col("_kinds") >= F.col("_ends") * ALIKE_TEXTS, block * ALIKE_TILES).otherwise(block)
    blocks = F.least("_kinds", F.ceil(F.greatest(F.col("_kinds"), F.col("_letters") / TILE_LETTERS) / tile))
    # the samples go along with each text: both sides read one shuffle, and sizes are not needed again
    rows = counted.join(sizes.select("prompt_id", "_n", blocks.cast("int").alias("_blocks")), "prompt_id")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("text"), "_blocks").cast("int"))
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    mine = F.col("_own") <= F.col("_other")
    low_block, high_block = F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    dealt = dealt.select("prompt_id", "_n", low_block, high_block, mine.alias("_first"), "text", "_c")
    # the number is given: small in bytes, tiles are long work, and would be put together in few tasks
    session = completions.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 32 * session.sparkContext.defaultParallelism)
    kind = completions.select("prompt_id").schema[0].dataType.simpleString()
    tiles = dealt.repartition(tasks, "prompt_id", "_i", "_j").groupBy("prompt_id", "_i", "_j")
    sums = tiles.applyInArrow(_tile_sums, f"prompt_id {kind}, _n long, _total long").groupBy("prompt_id").agg(F.max("_n").alias("_n"), F.sum("_total").alias("_total"))
    pairs = (F.col("_n") * (F.col("_n") - 1) / 2).cast("long")
    mean = F.col("_total") / F.greatest(pairs, F.lit(1))
    whole = sums.select("prompt_id", F.col("_n").alias("samples"), pairs.alias("pairs"), mean.cast("double").alias("mean_distance"))
    return whole.withColumn("low_diversity", F.col("mean_distance") < low)


def completion_diversity(completions: DataFrame, probe: int = PROBE_SIZE, low: float = LOW_DIVERSITY) -> DataFrame:
    """Mean edit distance of the completions of each prompt: one row per prompt.

    Up to ``probe`` samples are compared pair by pair.  The samples of a larger prompt are dealt to
    ``ceil(samples / probe)`` probes by the md5 of their id, and pairs are formed within probes: every
    sample counts, the pairs grow with the samples and not with their square, and a task holds a few texts.
    The mean is over all pairs, so probes weigh by their pairs; without any pair it is 0.
    """
    sizes = completions.groupBy("prompt_id").agg(F.count("*").alias("_n"))
    number = F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 8), 16, 10).cast("long")
    dealt = completions.join(sizes, "prompt_id").withColumn("probe_id", F.pmod(number, F.ceil(F.col("_n") / probe)))
    texts = dealt.groupBy("prompt_id", "probe_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("_texts"))
    distances = F.flatten(
        F.transform(
            "_texts",
            lambda a, i: F.transform(F.slice("_texts", i + 2, F.size("_texts")), lambda b: F.levenshtein(a, b)),
        )
    )
    rows = texts.withColumn("_d", distances)
    total = F.aggregate("_d", F.lit(0).cast("long"), lambda s, d: s + d)
    per_prompt = rows.groupBy("prompt_id").agg(
        F.sum(F.size("_texts")).alias("samples"), F.count("*").alias("probes"), F.sum(F.size("_d")).alias("pairs"), F.sum(total).alias("_total")
    )
    mean = F.col("_total") / F.greatest(F.col("pairs"), F.lit(1))
    return per_prompt.select("prompt_id", "samples", "probes", "pairs", mean.cast("double").alias("mean_distance")).withColumn(
        "low_diversity", F.col("mean_distance") < low
    )
