"""One consistent form for texts that look the same but are stored with different characters.

The words of the corpus are a vocabulary.  Its clean spellings (stored plainly, in letters of one script) form tries, one
for each bucket of words that begin alike; every odd word walks the trie of its bucket with a weighted edit automaton:
look-alike letters, accents stored apart, forms that stand for ordinary characters and characters that show as nothing
cost nothing, any edit that a reader would see costs one.  Of the spellings within the budget the cheapest and then most
frequent one is taken.  The budget is 0 by default, since a text must look as before; words that reach no spelling are
rewritten by the tables.  Whatever bucket and trie, words that look the same reach the same spellings, so texts that look
the same come out equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small, written
from .classes import SPAN, pair_rows

# Letters that are drawn like a Latin letter, and hyphens drawn like the ASCII one.
LOOK_ALIKE = dict(
    zip(
        "АВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝѵӏӀ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ" + "սօհո" + "ɡɑ" + "‐‑",
        "ABEKMHOPCTXSIJaeopcyxsijhdqwvlI" + "ABEZHIKMNOPTYXoc" + "uohn" + "ga" + "--",
        strict=True,
    )
)
#: Compatibility forms that stand for ordinary characters; raised, lowered, circled and fraction forms look different.
_STANDS_FOR = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>")
_FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"
_TOKEN = re.compile(r"[^ \n\t\r\v\f]+")


def shows_nothing(ch: str) -> bool:
    if ch in _FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return True
    kind = unicodedata.category(ch)
    return kind == "Cf" or kind == "Cc" and ch not in "\n\t\r\v\f\x1c\x1d\x1e\x1f\x85"


@lru_cache(1 << 16)
def plain(ch: str) -> str:
    """A stored character as the ordinary characters it stands for; accents are still apart."""
    if ch < "\x7f" and ch >= " " or ch in "\n\t":
        return ch
    if shows_nothing(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    whole = unicodedata.decomposition(ch)
    if whole.startswith("<"):
        kind, _, codes = whole.partition(" ")
        parts = "".join(chr(int(c, 16)) for c in codes.split())
        if kind in _STANDS_FOR and not parts.startswith(" "):
            return "".join(plain(c) for c in parts)
        return ch
    if whole:
        return "".join(plain(chr(int(c, 16))) for c in whole.split())
    return ch


def in_plain(text: str) -> str:
    """Text without invisible characters, with ordinary spaces, full characters for compatibility forms, and composed."""
    if text.isascii() and "\r" not in text and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(map(plain, text.replace("\r\n", "\n").replace("\r", "\n"))))


def skeleton(word: str) -> str:
    """What all spellings of a word have in common: plain, with each look-alike letter as the Latin one."""
    if word.isascii():
        return in_plain(word)
    apart = unicodedata.normalize("NFD", "".join(map(plain, word)))
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in apart))


def script(ch: str) -> str:
    return "" if not ch.isalpha() else unicodedata.name(ch, "?").partition(" ")[0]


def clean(word: str) -> bool:
    """Whether a word is stored plainly and in letters of one script."""
    return word.isascii() or in_plain(word) == word and len({script(c) for c in word} - {""}) <= 1 and "‐" not in word and "‑" not in word


_BACK = {s: {latin: own for own, latin in LOOK_ALIKE.items() if script(own) == s} for s in ("CYRILLIC", "GREEK")}


def by_table(form: str) -> str:
    """Spelling of a skeleton that no clean word of the corpus has: in the script of its letters that have no double."""
    scripts = Counter(script(c) for c in unicodedata.normalize("NFD", form) if script(c) and c not in LOOK_ALIKE.values())
    main = scripts.most_common(1)[0][0] if scripts else "LATIN"
    if main not in _BACK or any(script(c) == "LATIN" and c not in _BACK[main] for c in unicodedata.normalize("NFD", form)):
        return form
    return unicodedata.normalize("NFC", "".join(_BACK[main].get(c, c) for c in unicodedata.normalize("NFD", form)))


def _units(word: str) -> str:
    """What the automaton reads: ordinary characters with the accents apart, without what shows as nothing."""
    return unicodedata.normalize("NFD", "".join(map(plain, word)))


class Trie:
    """Clean spellings with their frequencies, by their characters with the accents apart."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (word, count + node[""][1] if "" in node else count)

    def nearest(self, word: str, budget: int = 0) -> str | None:
        """Cheapest, then most frequent, then smallest spelling within the budget: look-alikes and ignorables are free.

        The states of the automaton are nodes of the trie with what it cost to reach them.
        """
        states = self._with_missing({id(self.root): (0, self.root)}, budget)
        for c in _units(word):
            moved: dict[int, tuple] = {}
            latin = LOOK_ALIKE.get(c, c)
            for cost, node in states.values():
                if cost < budget:
                    self._reach(moved, cost + 1, node)  # a character more than the spelling has
                for other, below in node.items():
                    if other:
                        price = cost + (other != c and LOOK_ALIKE.get(other, other) != latin)
                        if price <= budget:
                            self._reach(moved, price, below)
            states = self._with_missing(moved, budget)
            if not states:
                return None
        ends = [(cost, -node[""][1], node[""][0]) for cost, node in states.values() if "" in node]
        return min(ends)[2] if ends else None

    @staticmethod
    def _reach(states: dict[int, tuple], cost: int, node: dict) -> None:
        if id(node) not in states or states[id(node)][0] > cost:
            states[id(node)] = (cost, node)

    def _with_missing(self, states: dict[int, tuple], budget: int) -> dict[int, tuple]:
        """The states, and those that characters of a spelling which the word lacks lead to."""
        work = [s for s in states.values() if s[0] < budget]
        while work:
            cost, node = work.pop()
            for other, below in node.items():
                if other and states.get(id(below), (cost + 2,))[0] > cost + 1:
                    states[id(below)] = (cost + 1, below)
                    if cost + 1 < budget:
                        work.append((cost + 1, below))
        return states


def _spaces() -> re.Pattern:
    return re.compile("[" + "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs") + "]")


_ODD_SPACE, _LINE_END = _spaces(), re.compile("\r\n?")


def spaced(text: str) -> str:
    """Every kind of single space as a space, every line end as LF."""
    if "\r" in text:
        text = _LINE_END.sub("\n", text)
    return text if text.isascii() else _ODD_SPACE.sub(" ", text)


def _ranges(codes: list[int]) -> str:
    out, begin = [], codes[0]
    for cp, following in zip(codes, [*codes[1:], -1], strict=True):
        if following != cp + 1:
            out.append(f"\\x{{{begin:X}}}-\\x{{{cp:X}}}")
            begin = following
    return "".join(out)


@lru_cache(1)
def odd_characters() -> str:
    """Pattern of the characters that aren't stored plainly or have a Latin double or an accent apart.

    ASCII characters, which most are, are settled before the long list of the others is gone through.
    """
    known = (*range(0x80), *range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0x2012, 0x2060), *range(0x20A0, 0x20C0))
    stable = {cp for cp in known if skeleton(chr(cp)) == chr(cp) and not unicodedata.combining(chr(cp))}
    low, high = [cp for cp in range(0x80) if cp not in stable], sorted(cp for cp in stable if cp >= 0x80)
    return f"[{_ranges(low)}[\\x{{80}}-\\x{{10FFFF}}&&[^{_ranges(high)}]]]"


@lru_cache(1 << 18)
def odd_form(word: str) -> str | None:
    """Skeleton of a word that isn't plainly spelled; null for one that is its own skeleton in letters of one script."""
    if word.isascii() and word.isprintable():
        return None
    form = skeleton(word)
    return None if form == word and clean(word) else form


#: Characters of a skeleton that put a word into its bucket, besides its length.
BUCKET_CHARS = 4


def _vocabulary(budget: int):
    """Words of each batch: once to be put into the trie (``walks`` false) if clean, once to walk it if odd."""
    head = BUCKET_CHARS if not budget else 0  # edits may change how a word begins, and its length

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text is not None:
                    counts.update(_TOKEN.findall(spaced(text)))
            rows = []
            for word, count in counts.items():
                form = odd_form(word)
                bucket = f"{len(form or word)}{(form or word)[:head]}" if head else (form or word)[:1]
                if form is not None:
                    rows.append((bucket, word, True, 0))
                if form is None or clean(word):
                    rows.append((bucket, word, False, count))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = {"bucket": pa.string(), "word": pa.string(), "walks": pa.bool_(), "count": pa.int64()}
            yield pa.record_batch({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    return run


def _spellings(budget: int):
    """Canonical spelling of each odd word.  Rows come bucket by bucket, those for its trie before those that walk it."""

    def run(batches):
        at, trie = None, Trie()
        for batch in batches:
            out = []
            for bucket, word, walks, count in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != at:
                    at, trie = bucket, Trie()
                if not walks:
                    trie.add(word, count)
                elif (spelling := trie.nearest(word, budget) or by_table(skeleton(word))) != word:
                    out.append((word, spelling))
            yield pa.record_batch({"word": pa.array([w for w, _ in out], pa.string()), "spelling": pa.array([s for _, s in out], pa.string())})

    return run


def _odd_words(batches):
    for batch in batches:
        ids, words = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in {w for w in _TOKEN.findall(spaced(text)) if odd_form(w) is not None}:
                ids.append(key)
                words.append(word)
        yield pa.record_batch({"id": pa.array(ids, batch.schema.field(0).type), "word": pa.array(words, pa.string())})


def _rewritten(batches):
    for batch in batches:
        out = []
        for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True):
            text = spaced(text)
            if words:
                change = {w["word"]: w["spelling"] for w in words}
                text = _TOKEN.sub(lambda m, change=change: change.get(m.group(), m.group()), text)
            out.append(text)
        yield pa.record_batch({"id": batch.column("id"), "text": batch.column("text"), "canonical": pa.array(out, pa.string())})


def canonical_texts(items: DataFrame, id_column: str, text: Column, budget: int = 0) -> DataFrame:
    """id, text and its consistent form ``canonical``; equal for texts that look the same, and looking like the text.

    A null text stays null and an empty one empty.  Ids must be unique.  The words of all texts are in the vocabulary;
    buckets without an odd word build no trie, and only texts that hold an odd character are joined with the spellings
    of their odd words: all others keep their words as they are and are never shuffled.  A ``budget`` above 0 lets odd
    words (those with odd characters only) be changed by so many visible edits into a spelling of the corpus; buckets are
    then all words with one first letter, and words that the tables would leave alike may part.
    """
    rows = items.select(F.col(id_column).alias("id"), text.alias("text"))
    kind = items.schema[id_column].dataType.simpleString()
    counted = rows.select("text").mapInArrow(_vocabulary(budget), "bucket string, word string, walks boolean, count bigint")
    words = written(counted.groupBy("bucket", "word", "walks").agg(F.sum("count").alias("count")), "vocabulary")
    asked = words.join(words.where("walks").select("bucket").distinct(), "bucket", "left_semi")
    known = asked.repartition("bucket").sortWithinPartitions("bucket", "walks").select("bucket", "word", "walks", "count")
    spellings = written(known.mapInArrow(_spellings(budget), "word string, spelling string"), "spellings")
    odd = rows.where(F.col("text").rlike(odd_characters()))
    wanted = odd.mapInArrow(_odd_words, f"id {kind}, word string")
    changes = wanted.join(small(spellings), "word").groupBy("id").agg(F.collect_list(F.struct("word", "spelling")).alias("words"))
    changed = odd.join(changes, "id", "left").select("id", "text", "words").mapInArrow(_rewritten, f"id {kind}, text string, canonical string")
    same = rows.where(F.col("text").isNull() | ~F.col("text").rlike(odd_characters()))
    return changed.unionByName(same.select("id", "text", F.regexp_replace("text", "\r\n?", "\n").alias("canonical")))


def same_looking(items: DataFrame, id_column: str, text: Column) -> DataFrame:
    """Pairs of items, neither null nor empty, that look the same and are stored differently: id_a < id_b."""
    forms = canonical_texts(items, id_column, text).where("text != ''")
    keyed = written(forms.select("id", F.md5("canonical").alias("form"), F.md5("text").alias("stored")), "forms")
    classes = written(keyed.groupBy("form", "stored").agg(F.count("*").alias("n")), "stored")
    several = written(classes.groupBy("form").agg(F.count("*").alias("n")).where("n > 1"), "several")
    one, two = (classes.select(F.col("form").alias(c), F.col("stored").alias(f"{c}_id")).join(several.select(F.col("form").alias(c)), c, "left_semi") for c in "ab")
    large = several.where(F.col("n") > SPAN).select(F.col("form").alias("class"), "n")
    pairs = pair_rows(several.select(F.col("form").alias("a"), F.col("form").alias("b")), one, two, large, large).where("a_id < b_id")
    left, right = (keyed.select(F.col("stored").alias(c), F.col("id").alias(f"{c}_id")) for c in "ab")
    large = classes.where(F.col("n") > SPAN).select(F.col("stored").alias("class"), "n")
    both = pair_rows(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), left, right, large, large)
    return both.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))
