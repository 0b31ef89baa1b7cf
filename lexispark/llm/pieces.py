"""Cutting oversized texts at natural boundaries, by dynamic programming over the boundary positions of each text.

Every text is cut into pieces of at most ``limit`` characters.  Of all ways to do so, the one is taken with the fewest
cuts inside a word, then with the fewest cuts between words of one sentence, and then with the least sum of cut
penalties (paragraph < line < sentence), of squared deviation from the even size, and of overlap given up.  Pieces are
slices of the text: their new parts, joined in order, are the text again, character by character.

Texts are independent, so the work is one pass without a shuffle.  Null texts give no piece, texts up to the limit
(empty ones too) give one piece, repeated ids give the pieces of each of their rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that follows ``.``, ``?`` or ``!``, and line breaks with what white space comes after them.
_NATURAL = re.compile(r"(?<=[.?!])\s+|[\r\n]\s*")
_SPACE = re.compile(r"\s+")
#: Cost of a cut by kind; those of forced cuts exceed what any number of pieces can gain elsewhere.
PENALTY = {"paragraph": 0.0, "line": 0.05, "sentence": 0.1, "outer": 0.2, "word": 1e4, "inside": 1e8}
FORCED = ("word", "inside")


def cut_positions(text: str, limit: int) -> tuple[list[int], list[str]]:
    """Possible ends of pieces, ascending, with their kinds; no two neighbours are further apart than ``limit``."""
    n = len(text)
    ends: dict[int, str] = {}
    solid = []  # stretches without natural boundary, outer white space left out
    begin = n - len(text.lstrip())
    if begin:
        ends.update((p, "outer") for p in (*range(limit, begin, limit), begin) if p < n)
    for m in _NATURAL.finditer(text):
        stop = m.end()
        if stop <= begin:
            continue
        start = m.start()
        while start > begin and text[start - 1].isspace():
            start -= 1
        gap = text[start:stop]
        lines = gap.replace("\r\n", "\n")
        breaks = lines.count("\n") + lines.count("\r")
        kind = "paragraph" if breaks > 1 else "line" if breaks else "sentence"
        solid.append((begin, start))
        if stop < n:
            ends[stop] = kind
        if stop - start > 1 or stop == n or stop - begin > limit:  # a full stretch must do without the space after it
            ends.update((p, "outer") for p in range(start, min(stop, n), limit) if p and p not in ends)
        begin = stop
    if begin < n:
        last = len(text.rstrip())
        if last > begin:
            solid.append((begin, last))
        if last < n:
            ends.update((p, "outer") for p in range(max(last, 1), n, limit) if p not in ends)
    for a, b in solid:
        if b - a > limit:
            at = a
            for p in (*(m.end() for m in _SPACE.finditer(text, a, b) if m.end() < b), b):
                while p - at > limit // 10:
                    at += limit // 10
                    while at < p and unicodedata.combining(text[at]):
                        at += 1
                    if at < p:
                        ends.setdefault(at, "inside")
                if p < b:
                    ends.setdefault(p, "word")
                at = p
    ends[n] = "end"
    order = sorted(ends)
    return order, [ends[p] for p in order]


def best_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of the pieces of one text."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    ends, kinds = cut_positions(text, limit)
    ends, kinds = [0, *ends], ["", *kinds]
    whole = max(1, -(-(n - overlap) // max(1, limit - overlap)))
    even = min(limit, n / whole + overlap)
    cost, back, low = [0.0] * len(ends), [0] * len(ends), 0
    for i in range(1, len(ends)):
        end = ends[i]
        while end - ends[low] > limit:
            low += 1
        best, choice = float("inf"), low
        for j in range(low, i):
            size = end - ends[j]
            c = cost[j]
            if c >= best:
                continue
            if j:
                room = limit - size
                if room >= overlap:
                    size += overlap
                else:
                    size = limit
                    c += 0.3 * (1 - room / overlap) if overlap else 0.0
            off = (size - even) / limit
            c += off * off
            if c < best:
                best, choice = c, j
        cost[i], back[i] = best + PENALTY.get(kinds[i], 0.0), choice
    chain, i = [], len(ends) - 1
    while i:
        chain.append(i)
        i = back[i]
    chain.reverse()
    natural = [p for p, k in zip(ends, kinds, strict=True) if k in ("paragraph", "line", "sentence")]
    out, before, cut = [], 0, 0
    for i in chain:
        end = ends[i]
        start = cut
        if cut and overlap:
            least = max(cut - overlap, end - limit, before)
            k = bisect_left(natural, least)
            if k < len(natural) and natural[k] < cut:
                start = natural[k]
            elif least < cut:
                space = _SPACE.search(text, least, cut)
                start = space.end() if space and space.end() < cut else least
                while start < cut and unicodedata.combining(text[start]):
                    start += 1
        out.append((start, end, kinds[i]))
        before, cut = cut, end
    return out


def _pieces(limit: int, overlap: int, with_text: bool):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                cuts = best_cuts(text, limit, overlap)
                forced = sum(k in FORCED for _, _, k in cuts)
                before = 0
                for number, (start, end, kind) in enumerate(cuts):
                    for column, value in zip(rows, (key, number, len(cuts), forced, start, end, before - start if number else 0, kind, text[start:end] if with_text else None), strict=True):
                        column.append(value)
                    before = end
            kinds = (batch.schema.field(0).type, *[pa.int32()] * 6, pa.string(), pa.string())
            names = ("id", "piece_no", "n_pieces", "n_forced", "start", "end", "overlap", "cut", "text")
            yield pa.record_batch({n: pa.array(r, k) for n, r, k in zip(names, rows, kinds, strict=True) if n != "text" or with_text})

    return run


def pieces(items: DataFrame, id_column: str, text: Column, limit: int = 500, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """Cut every text into pieces: one row per piece, with its place in the text and how it ends.

    ``n_forced`` counts the cuts of the whole text that no natural boundary allowed; it is above 0 just if the text has
    a stretch of more than ``limit`` characters without one, outer white space not counted.  ``overlap`` is the number
    of characters that the piece repeats of the one before.  Columns of ``items`` other than the two are not read.
    """
    if not 0 <= overlap < limit or limit < 20:
        raise ValueError("0 <= overlap < limit and 20 <= limit are needed")
    kind = items.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece_no int, n_pieces int, n_forced int, start int, end int, overlap int, cut string" + ", text string" * with_text
    return items.select(F.col(id_column).alias("id"), text.alias("text")).mapInArrow(_pieces(limit, overlap, with_text), schema)
