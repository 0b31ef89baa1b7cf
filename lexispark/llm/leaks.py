"""Evaluation texts that stand in training text: q-gram counting in diagonal bands, then banded alignment.

The stated query set (cases) is searched against all records, in blocks of bounded size; each block's q-grams go to
every task, the records are read once a block and never shuffled.  Both sides are compared as folded words with one
space between them.  A passage of ``w`` characters with at most ``e`` edits keeps ``w + 1 - q (e + 1)`` of its q-grams
within ``e`` diagonals (q-gram lemma), so a band of diagonals with fewer hits holds no such passage; bands overlap by
half, so every run of near diagonals lies whole in one.  What is left is verified by local alignment inside the band.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .words import _powers, chunks, mix, split_words, word_text

#: Characters of the cases of one block, as stored; a larger query set is searched in several blocks.
BLOCK_CHARS = 4_000_000
#: q-gram lengths; a passage uses the longest that leaves two fifths of its shortest part's q-grams within the edits.
LENGTHS = (12, 8, 6, 4, 3, 2, 1)
_TABLE_BITS = 23
_LOSS = 4


@dataclass
class Passage:
    """A distinct text to look for, by whole word runs of at least ``run`` words."""

    text: str
    run: int
    kind: str
    cases: list = field(default_factory=list)

    def __post_init__(self):
        self.words = self.text.split(" ")
        ends = np.cumsum([len(w) + 1 for w in self.words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        #: where each run of words begins and ends, and the length of the shortest
        self.begins, self.ends = starts[: len(self.words) - self.run + 1], ends[self.run - 1 :]
        self.least = int((self.ends - self.begins).min())
        self.parts = {" ".join(self.words[i : i + self.run]) for i in range(len(self.words) - self.run + 1)}

    def shortest(self, top: int, bottom: int) -> int:
        """Length of the shortest run of words that has a character in this part of the passage."""
        i, j = np.searchsorted(self.ends, top, side="right"), np.searchsorted(self.begins, bottom)
        return int((self.ends[i:j] - self.begins[i:j]).min(initial=1 << 30))

    def stands_in(self, region: list[str]) -> bool:
        return any(" ".join(region[i : i + self.run]) in self.parts for i in range(len(region) - self.run + 1))


def passages_of(cases: list[tuple], run: int) -> list[Passage]:
    """From (case id, doc, query): docs of at least ``run`` words count by runs of them, queries as a whole."""
    found: dict[tuple, Passage] = {}
    for case, doc, query in cases:
        for kind, text in (("doc", doc), ("query", query)):
            folded = word_text(split_words([text]), 0)
            count = len(folded.split(" ")) if folded else 0
            if count >= (run if kind == "doc" else 1):
                passage = found.setdefault((kind, folded), Passage(folded, run if kind == "doc" else count, kind))
                if case not in passage.cases:
                    passage.cases.append(case)
    return list(found.values())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gram_hashes(chars: np.ndarray, values: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each character."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    forth, back = _powers(max(10, int(len(chars)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * forth[: len(chars)])])
    return mix((sums[q:] - sums[:-q]) * back[: len(chars) - q + 1])


class Index:
    """q-grams of all passages of one block that use the same q."""

    def __init__(self, passages: list[Passage], edits: int, q: int):
        self.q, self.passages, self.edits = q, passages, edits
        hashes, which, at = [], [], []
        for k, p in enumerate(passages):
            chars = _codes(p.text)
            h = _gram_hashes(chars, mix(chars.astype(np.uint64)), q)
            hashes.append(h)
            which.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        h, which, at = (np.concatenate(x) for x in (hashes, which, at))
        order = np.argsort(h, kind="stable")
        self.hashes, self.which, self.at = h[order], which[order], at[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.least = np.array([max(1, p.least + 1 - q * (edits + 1)) for p in passages])
        self.chars = [_codes(p.text) for p in passages]
        self.lengths = np.array([len(c) for c in self.chars])

    def regions(self, chars, values, text_of, begin):
        """Bands with enough hits: text, passage, first and last diagonal inside the text, part of the passage."""
        h = _gram_hashes(chars, values, self.q)
        p = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).view(np.int64)])
        low = np.searchsorted(self.hashes, h[p])
        count = np.searchsorted(self.hashes, h[p], side="right") - low
        p, low, count = p[count > 0], low[count > 0], count[count > 0]
        hit = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p = np.repeat(p, count)
        text, passage, at = text_of[p], self.which[hit], self.at[hit]
        diagonal = p - begin[text] - at
        pair = text.astype(np.int64) * len(self.passages) + passage
        band = diagonal // (self.edits + 1)  # each band and the next are counted together
        pair, band = np.concatenate([pair, pair]), np.concatenate([band, band - 1])
        diagonal, at = np.concatenate([diagonal, diagonal]), np.concatenate([at, at])
        order = np.lexsort((band, pair))
        pair, band, diagonal, at = pair[order], band[order], diagonal[order], at[order]
        if not len(pair):
            return [np.zeros(0, np.int64)] * 7
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
        count = np.diff(np.concatenate([first, [len(pair)]]))
        keep = count >= self.least[pair[first] % len(self.passages)]
        low, high = np.minimum.reduceat(diagonal, first)[keep], np.maximum.reduceat(diagonal, first)[keep]
        top, bottom = np.minimum.reduceat(at, first)[keep], np.maximum.reduceat(at, first)[keep]
        pair, count = pair[first][keep], count[keep]
        around = self.edits * (self.q + 1)  # no further from a hit is a character that fits within the edits
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(pair) else np.zeros(0, bool)
        pair, low, high, top, bottom, count = pair[new], low[new], high[new], top[new], bottom[new], count[new]
        passage = pair % len(self.passages)
        top, bottom = np.maximum(0, top - around), np.minimum(self.lengths[passage], bottom + self.q + around)
        local = np.array([self.passages[g].shortest(i, j) for g, i, j in zip(passage, top, bottom, strict=True)], np.int64)
        keep = count >= local + 1 - self.q * (self.edits + 1)
        return [x[keep] for x in (pair // len(self.passages), passage, low, high, top, bottom, local)]


def align(chars, first, last, lines, low, high):
    """Best local alignment of each line with the text around it: (score, start, end) in ``chars``.

    Line k lies on the diagonals ``low[k]`` to ``high[k]`` of ``chars``, inside ``first[k]`` to ``last[k]``.  A match
    counts 1, an edit ``-_LOSS``.  All lines advance together, one character a step.
    """
    width, lengths = int((high - low).max()) + 1, np.array([len(x) for x in lines])
    text = np.zeros((len(lines), lengths.max()), np.uint32)
    for k, line in enumerate(lines):
        text[k, : len(line)] = line
    text = np.ascontiguousarray(text.T)
    across = np.arange(width)[:, None]
    inside = across <= (high - low)[None, :]
    padded = np.concatenate([chars, np.zeros(width + len(text), np.uint32)])
    score, origin = (np.zeros((width + 1, len(lines)), np.int32) for _ in "so")
    best, best_from, best_to = (np.zeros(len(lines), np.int32) for _ in "sft")
    rows = np.arange(len(lines))
    for i in range(len(text)):
        at = low + across + i
        valid = inside & (at >= first) & (at < last) & (i < lengths)
        equal = padded[np.maximum(at, 0)] == text[i]
        new = score[:-1] + np.where(equal, 1, -_LOSS)
        start = np.where(score[:-1] > 0, origin[:-1], at)
        skip = score[1:] - _LOSS  # a character of the line is missing in the text
        better = skip > new
        new, start = np.where(better, skip, new), np.where(better, origin[1:], start)
        new = np.where(valid, np.maximum(new, 0), 0)
        for d in range(1, width):  # the text has a character more
            more = new[d - 1] - _LOSS
            better = valid[d] & (more > new[d])
            new[d] = np.where(better, more, new[d])
            start[d] = np.where(better, start[d - 1], start[d])
        score[:-1], origin[:-1] = new, start
        top = new.argmax(0)
        value = new[top, rows]
        better = value > best
        best = np.where(better, value, best)
        best_from, best_to = np.where(better, start[top, rows], best_from), np.where(better, at[top, rows] + 1, best_to)
    return best, best_from, best_to


def indexes(passages: list[Passage], edits: int) -> list[Index]:
    """Passages by q and edit budget: short ones get a smaller q, the shortest no edits."""
    groups: dict[tuple, list] = {}
    for p in passages:
        budget = edits if p.least >= 4 * (edits + 1) else 0
        q = next(q for q in LENGTHS if q == 1 or q * (budget + 1) <= 0.6 * p.least)
        groups.setdefault((q, budget), []).append(p)
    return [Index(group, budget, q) for (q, budget), group in sorted(groups.items(), reverse=True, key=lambda x: x[0])]


def folded_batch(texts):
    """Characters of all texts, folded, one space after each word; begin and end of each text; the text of each."""
    words = split_words(texts)
    is_word = words.chars != 0
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    chars = np.where(is_word, words.chars, np.uint32(32))[keep]
    a, b = words.first[:-1], words.first[1:]
    none = a == b
    if len(words.starts):
        begin = place[words.starts[np.minimum(a, len(words.starts) - 1)]]
        end = place[words.ends[np.maximum(b - 1, 0)]]
    else:
        begin = end = np.zeros(len(texts), np.int64)
    begin, end = np.where(none, 0, begin), np.where(none, 0, end)
    text_of = np.repeat(np.flatnonzero(~none), (end - begin + 1)[~none])
    return chars, begin, end, text_of


def _search(shared, kind: str):
    def run(batches):
        passages, edits = shared.value
        found = indexes(passages, edits)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            held, parts, size = [], [], 0
            for offset, part in chunks(texts):
                chars, begin, end, text_of = folded_batch(part)
                values = mix(chars.astype(np.uint64))
                for which, index in enumerate(found):
                    text, passage, low, high, top, bottom, local = index.regions(chars, values, text_of, begin)
                    at = begin[text] + size
                    held.append(np.stack([text + offset, np.full(len(text), which), passage, low + at, high + at, top, bottom, local, at, end[text] + size], 1))
                parts.append(chars)
                size += len(chars)
            yield _verified(found, ids, np.concatenate(parts), np.concatenate(held)) if held else _rows(ids, [])

    return run


def _rows(ids, rows: list[tuple]):
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = {"case_id": pa.string(), "exact": pa.bool_(), "score": pa.int32(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32()}
    return pa.record_batch({"id": ids.take(pa.array(columns[0], pa.int64())), **{n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns[1:], strict=True)}})


def _verified(found: list[Index], ids, chars: np.ndarray, regions: np.ndarray):
    """The regions of a batch whose alignment keeps within the edits: the best of each text and case."""
    hits: dict[tuple, tuple] = {}
    regions = regions[np.argsort(regions[:, 6] - regions[:, 5], kind="stable")]
    for k in range(0, len(regions), 1024):
        text, which, passage, low, high, top, bottom, local, first, last = regions[k : k + 1024].T
        budget = np.array([found[w].edits for w in which])
        lines = [found[w].chars[g][i:j] for w, g, i, j in zip(which, passage, top, bottom, strict=True)]
        score, start, stop = align(chars, first, last, lines, low - budget + top, high + budget + top)
        for n in np.flatnonzero(score >= local - budget * (1 + _LOSS)):
            p = found[which[n]].passages[passage[n]]
            a, b = max(first[n], low[n] - budget[n]), min(last[n], high[n] + len(p.text) + budget[n])
            hit = (p.stands_in(_region(chars, first[n], last[n], a, b)), int(score[n]), p.kind, int(start[n] - first[n]), int(stop[n] - first[n]))
            for case in p.cases:
                hits[text[n], case] = max(hit, hits.get((text[n], case), hit))
    return _rows(ids, [(*key, *hit) for key, hit in hits.items()])


def _region(chars: np.ndarray, begin: int, end: int, a: int, b: int) -> list[str]:
    """Whole words of the text around its characters a to b."""
    while a > begin and chars[a - 1] != 32:
        a -= 1
    while b < end and chars[b] != 32:
        b += 1
    return chars[a:b].tobytes().decode("utf-32-le", "surrogatepass").split()


def leaks(records: DataFrame, id_column: str, text: Column, cases: DataFrame, case_id: Column, doc: Column, query: Column, run: int = 10, edits: int = 1) -> DataFrame:
    """Records that hold ``run`` consecutive words of a case's doc, or all words of its query, up to ``edits`` edits.

    One row for each record and case: id, case_id, exact (the words stand there without any edit), score and kind of
    the best alignment, and its place among the folded characters of the record.  Null and empty texts and cases match
    nothing, a doc of fewer than ``run`` words can't leak by its doc, equal cases are all reported, and repeated record
    ids are reported for each of their rows.  Cases with a null id are left out.
    """
    spark = records.sparkSession
    cases = cases.select(case_id.cast("string").alias("case"), doc.alias("doc"), query.alias("query")).where("case is not null")
    size = cases.agg(F.sum(F.coalesce(F.length("doc"), F.lit(0)) + F.coalesce(F.length("query"), F.lit(0)) + 1)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    rows = records.select(F.col(id_column).alias("id"), text.alias("text")).where("text is not null")
    kind = records.schema[id_column].dataType.simpleString()
    out = None
    for k in range(blocks):
        block = cases.where(F.pmod(F.xxhash64("case"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((passages_of([tuple(r) for r in block], run), edits))
        part = rows.mapInArrow(_search(shared, kind), f"id {kind}, case_id string, exact boolean, score int, kind string, start int, end int")
        if blocks > 1:  # one block in memory at a time
            part = written(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out
