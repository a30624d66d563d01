"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of words that repeats with a period, as long as it can be.
Words are appended one by one to a suffix automaton. Its suffix links form a
tree in which the path from the newest state to the root holds all suffixes of
what has been read, and each node is coloured with the place where its strings
last ended. Nodes of one colour along such a path form the segments of a
link-cut tree: *access* to the newest state walks over the segments of its
path and recolours all of them with the new place. A segment that was coloured
``e`` when word ``i`` is appended, and whose longest string has ``l`` words,
says that the last ``l`` words were last seen ``d = i - e`` places before. If
``d <= l`` the two occurrences touch and the last ``l + d`` words have period
``d``: a square, and the widest one to the left with this period. The start
stays the same while the run goes on, so the last report of a (start, period)
is the run, extended both ways.

For runs of at least ``repeats`` (two or more) periods the period found is the
smallest: with a smaller one that divides it, the same words would have been
seen later than ``e``.

A word in a run of at least ``repeats`` whole periods occurs that often inside
it. Words that are rarer in their part of the text can therefore lie in no run
and cut the text into parts, which are cut again the same way a few times; what
is left goes through the automaton. Nothing that can be in a run is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, whole

REPEATS = 4
LEAST_WORDS = 6
CUTS = 8  # a part is cut again this often before it goes to the automaton, so that cutting stays linear


class PathColours:
    """Link-cut tree over suffix links: each preferred path is a splay tree with one colour.

    Depth along the path is the order in the splay tree. Only its root's colour
    counts; it moves with the root, so nothing is pushed down. Node 0 stands
    for none, node 1 is the automaton's first state.
    """

    def __init__(self, room: int):
        self.left, self.right, self.up = (array("i", bytes(4 * room)) for _ in range(3))
        self.colour = array("i", bytes(4 * room))  # place of the last end, from 1; 0 is never

    def splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        root = x
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                # zig-zig turns the parent first, zig-zag turns x twice
                top = up[g]
                if (left[g] == p) == (left[p] == x):
                    if left[p] == x:
                        b = left[g] = right[p]
                        right[p] = g
                    else:
                        b = right[g] = left[p]
                        left[p] = g
                    if b:
                        up[b] = g
                    up[g] = p
                    if left[p] == x:
                        b = left[p] = right[x]
                        right[x] = p
                    else:
                        b = right[p] = left[x]
                        left[x] = p
                    if b:
                        up[b] = p
                    up[p] = x
                else:
                    if left[p] == x:
                        b = left[p] = right[x]
                        c = right[g] = left[x]
                        right[x], left[x] = p, g
                    else:
                        b = right[p] = left[x]
                        c = left[g] = right[x]
                        left[x], right[x] = p, g
                    if b:
                        up[b] = p
                    if c:
                        up[c] = g
                    up[p] = up[g] = x
                root = g
            else:
                top = g
                if left[p] == x:
                    b = left[p] = right[x]
                    right[x] = p
                else:
                    b = right[p] = left[x]
                    left[x] = p
                if b:
                    up[b] = p
                up[p] = x
                root = p
            up[x] = top
            if top:
                if left[top] == root:
                    left[top] = x
                elif right[top] == root:
                    right[top] = x
            p = top
        if root != x:
            self.colour[x] = self.colour[root]

    def insert_above(self, new: int, x: int) -> None:
        """A new node between ``x`` and its parent, of the colour of ``x``."""
        self.splay(x)
        above = self.left[x]
        self.left[new] = above
        if above:
            self.up[above] = new
        self.left[x] = new
        self.up[new] = x

    def recolour(self, x: int, place: int) -> list[tuple[int, int]]:
        """Access: gives the path from ``x`` to the root one colour.

        Returns its segments before, deepest first: (deepest node, colour).
        """
        left, right, up, colour = self.left, self.right, self.up, self.colour
        segments = []
        below, at = 0, x
        while at:
            # a node without children here is a root already
            if left[at] or right[at] or (up[at] and (left[up[at]] == at or right[up[at]] == at)):
                self.splay(at)
            cut = right[at]
            if cut:
                colour[cut] = colour[at]  # what is deeper than the path keeps its colour
            segments.append((at, colour[at]))
            right[at] = below
            below, at = at, up[at]
        colour[below] = place
        # the root of the last splay tree is the root of the whole path
        return segments


def squares(words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(end, length, period) of the suffixes that repeat, for each appended word; numbered from 0.

    Each is as long as it can be to the left; ``length >= 2 * period``.
    """
    room = 2 * len(words) + 2
    tree = PathColours(room)
    longest, link = array("i", bytes(4 * room)), array("i", bytes(4 * room))
    # most states have one way on: it is kept apart from the states that branch
    first_word, first_to = array("i", [-1]) * room, array("i", bytes(4 * room))
    more: dict[int, dict[int, int]] = {}
    states = last = 1
    up = tree.up
    for i, w in enumerate(words):
        states += 1
        new = states
        longest[new] = i + 1
        p = last
        while p:
            if first_word[p] == w or (p in more and w in more[p]):
                break
            if first_word[p] < 0:
                first_word[p], first_to[p] = w, new
            else:
                more.setdefault(p, {})[w] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = first_to[p] if first_word[p] == w else more[p][w]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                states += 1
                copy = states
                longest[copy] = longest[p] + 1
                first_word[copy], first_to[copy] = first_word[q], first_to[q]
                if q in more:
                    more[copy] = dict(more[q])
                link[copy] = link[q]
                tree.insert_above(copy, q)
                link[q] = link[new] = copy
                while p:
                    if first_word[p] == w:
                        if first_to[p] != q:
                            break
                        first_to[p] = copy
                    elif p in more and more[p].get(w) == q:
                        more[p][w] = copy
                    else:
                        break
                    p = link[p]
        up[new] = link[new]
        last = new
        for node, end in tree.recolour(new, i + 1):
            if end and longest[node] >= (period := i + 1 - end):
                yield i, longest[node] + period, period


def _parts(words: Sequence[int], start: int, repeats: int, least: int) -> Iterator[tuple[int, Sequence[int]]]:
    """Stretches of words which all occur ``repeats`` times within their stretch, or have been cut ``CUTS`` times."""
    pending = [(start, words, 0)]
    while pending:
        start, words, cuts = pending.pop()
        if len(words) < least:
            continue
        counts = Counter(words)
        if cuts == CUTS or min(counts.values()) >= repeats:
            yield start, words
            continue
        begin = None
        for i, w in enumerate(words):
            if counts[w] >= repeats:
                if begin is None:
                    begin = i
            elif begin is not None:
                if i - begin >= least:
                    pending.append((start + begin, words[begin:i], cuts + 1))
                begin = None
        if begin is not None and begin:
            pending.append((start + begin, words[begin:], cuts + 1))


def runs(words: Sequence, repeats: int = REPEATS, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with ``length >= max(least, repeats * period)``, by start, then period."""
    if repeats < 2:
        raise ValueError("a run repeats twice at least")
    found: dict[tuple[int, int], int] = {}
    for start, part in _parts(words, 0, repeats, max(least, repeats)):
        numbers: dict = {}
        for end, length, period in squares([numbers.setdefault(w, len(numbers)) for w in part]):
            if length >= repeats * period and length >= least:
                found[start + end + 1 - length, period] = length
    return sorted((start, length, period) for (start, period), length in found.items())


def collapsed(words: Sequence, found: list[tuple[int, int, int]]) -> list:
    """The words without what a run repeats: of each run its first period stays."""
    if not found:
        return list(words)
    kept, at = [], 0
    for begin, end in sorted((s + q, s + n) for s, n, q in found):
        if begin > at:
            kept += words[at:begin]
        at = max(at, end)
    return kept + list(words[at:])


def best_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Greatest length by period; of equal ones the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)
Words = list[bytes]


def find_runs(
    documents: DataFrame,
    repeats: int = REPEATS,
    least: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    prepare: Callable[[int | None, Words], Words] | None = None,
    with_collapsed: bool = False,
) -> DataFrame:
    """One row per document with its runs of words.

    Words are runs of anything but space and the five ASCII controls around
    tab, compared as they are. ``n_runs`` counts the runs of at least ``repeats``
    periods and ``least`` words; ``start, length, period, exponent_milli``
    describe the one with most periods (null without runs). ``runs_sha256`` and
    ``collapsed_sha256`` are digests of the list of runs and of the text without
    repetitions, which ``with_collapsed`` adds as ``collapsed``. Null and empty
    texts have no words and no runs. Each row is judged by itself: repeated rows
    and rows without id give a row each. A text of n words takes about 100 n
    bytes and is handled by one task. ``prepare`` may change the words of a
    document before.
    """
    plain = documents.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def judged(doc_id: int | None, text: str) -> tuple:
        words = text.encode().split()  # of bytes: ASCII white space only
        if prepare is not None:
            words = prepare(doc_id, words)
        found = runs(words, repeats, least)
        start, length, period = best_run(found) or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = b" ".join(collapsed(words, found))
        return (
            doc_id, len(found), start, length, period, 1000 * length // period if found else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left.decode() if with_collapsed else None,
        )

    shape = plain.sparkSession.createDataFrame([], COLUMNS + (", collapsed string" if with_collapsed else "")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [judged(i.as_py(), t.as_py()) for i, t in zip(part.column("doc_id"), part.column("text"))]
                columns = list(zip(*rows))[: len(shape)]
                types = [pa.int64()] * 6 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=shape.names)

    return plain.mapInArrow(run, shape)


def repeated_tail(doc_id: int | None, words: Words) -> Words:
    """Of every tenth document by a hash of its id, the end is replaced by repetitions of a stretch of it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


def op12(spark, sf_dir):
    return find_runs(table(spark, sf_dir, "documents"), prepare=repeated_tail)
