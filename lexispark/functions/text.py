"""Text functions as Spark columns: folding, stemming, tokenising and the small rules of the scorers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, French and English, without accents. Negations are not among them.
FRENCH_STOPWORDS = """
a ai aie aient aies ait as au aupres aussi autre autres aux avaient avais avait avec avoir avons ayant
c ca car ce ceci cela celle celles celui ceux ces cet cette chaque chez comme comment d dans de des deja depuis donc
dont du elle elles en encore entre es est et etaient etais etait etant ete etes etre eu eux fait fois font furent
fut ici il ils j je jusqu jusque l la le les leur leurs lors lorsqu lorsque lui m ma mais me meme memes mes moi
moins mon n ne nos notre nous on ont ou par parce pendant peu peut peuvent plus pour pourquoi puis qu quand
que quel quelle quelles quels qui quoi s sa se selon ses si soi soit sommes son sont sous suis sur t ta te tes
toi ton tous tout toute toutes tres tu un une vers voici voila vos votre vous y
""".split()
ENGLISH_STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but
by can could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me more most my myself nor of off on once only or other our
ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
""".split()
STOPWORDS = sorted({*FRENCH_STOPWORDS, *ENGLISH_STOPWORDS})
# Words left out of the overlap share, and words that negate.
OVERLAP_STOPWORDS = "le la les un une des du de d en pour et à au aux par dans sur ce cette ces".split()
NEGATIONS = "aucun aucune pas sans jamais non no not none never".split()
# Phrases that speak for each category, in folded text.
CATEGORY_PHRASES = {
    0: ("droits de l'homme", "droits fondamentaux", "cedh", "convention europeenne", "liberte d'expression", "constitution", "discrimination", "vie privee"),
    1: ("commerce", "commercial", "societe", "fiscal", "impot", "tva", "faillite", "douane", "bancaire", "financier"),
    2: ("arrete", "ministre", "ministeriel", "reglement grand-ducal", "communal", "nomination", "fonction publique", "administratif"),
    3: ("code civil", "famille", "divorce", "succession", "mariage", "enfant", "filiation", "responsabilite civile", "tutelle"),
}
UNCLEAR = -100
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _spans(codes: list[int]) -> str:
    """Inside of a pattern's brackets for the code points, given in order."""
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c != after - 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


@lru_cache(1)
def _foldings() -> tuple[str, str, dict[str, str], str]:
    """Characters that fold to one character and what to, those that fold to several, and the marks that fall away.

    By rule: the compatibility decomposition without combining marks.  Hangul syllables and what decomposes into other
    scripts' signs without a letter or digit are left as they are: no term depends on them.
    """
    one, several, marks = {}, {}, []
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(cp)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            one[ch] = base
        elif base != ch and any(c.isalnum() for c in base):
            several[ch] = base
    return "".join(one), "".join(one.values()), several, "".join(map(chr, marks))


@lru_cache(1)
def _folding_arguments() -> tuple[str, str, str, str]:
    letters, plain, several, marks = _foldings()
    rare = f"[[\\x{{BC}}-\\x{{BE}}\\x{{100}}-\\x{{10FFFF}}]&&[{_spans(sorted(map(ord, several)))}]]"  # most characters are settled by the first range
    return letters + marks, plain, "\x01".join(f"{a}\x02{b}" for a, b in several.items()), rare


def fold_accents(text: Column) -> Column:
    """Lower case, compatibility forms as what they stand for, without accents; all on the JVM.

    Characters that stand for several (ligatures, Roman numerals, fractions) are rare: only texts that hold one are taken
    apart for them.
    """
    letters, plain, several, rare = _folding_arguments()
    low = F.lower(text)
    table = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))
    spelled = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    out = F.when(low.rlike(rare), spelled(low)).otherwise(low)
    return F.translate(out, letters, plain)  # what has no counterpart falls away


def light_stem(word: Column) -> Column:
    """Plural and final e off, then seven letters; words of up to four letters and those with digits stay."""
    shorter = lambda w: F.substring(w, F.lit(1), F.length(w) - 1)
    one = F.when(word.endswith("s") | word.endswith("x"), shorter(word)).otherwise(word)
    two = F.when((F.length(one) > 4) & one.endswith("e"), shorter(one)).otherwise(one)
    return F.when((F.length(word) <= 4) | word.rlike(r"[\p{N}_]"), word).otherwise(F.substring(two, 1, 7))


def terms(text: Column, stem: bool = True, stopwords: bool = False) -> Column:
    """Terms of a text in order, repeated ones too: an array, empty for a null text."""
    words = F.regexp_extract_all(fold_accents(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    left_out = ["_", *([] if stopwords else STOPWORDS)]
    words = F.call_function("filter", words, F.expr("w -> w NOT IN (" + ", ".join(f"'{w}'" for w in left_out) + ")"))
    return F.transform(words, light_stem) if stem else words


def normalize(text: Column) -> Column:
    """Lower case, one space for white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def long_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)


def rule_stem(word: Column) -> Column:
    """Stem of the keyword rule: all final s, then all final e, endings -iqu and -abl, five letters."""
    bare = F.regexp_replace(F.regexp_replace(word, "s+$", ""), "e+$", "")
    short = F.when((F.length(bare) >= 6) & bare.rlike("(iqu|abl)$"), F.regexp_replace(bare, "(iqu|abl)$", "")).otherwise(bare)
    return F.substring(short, 1, 5)


def clean_text(text: Column) -> Column:
    """Without web addresses, one space for white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"http(?U)\S+", ""), r"(?U)\s+", " "))


def record_id(title: Column, content: Column) -> Column:
    return F.substring(F.sha1(F.concat(title, F.lit("\n"), content)), 1, 12)


def split_of(key: Column, shares: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "val", "test")) -> Column:
    """Split of a key by its hash; equal keys always go to the same split."""
    place = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    ends, at = [], 0.0
    for share in shares:
        at += share
        ends.append(at)
    out = F.lit(names[-1])
    for name, end in reversed(list(zip(names, ends, strict=True))):
        out = F.when(place < F.lit(end), F.lit(name)).otherwise(out)
    return out


def weak_category(jurisdiction: Column, title: Column, content: Column) -> Column:
    """Category whose phrases occur most; unclear when none does or two are equal; ``droit`` courts are category 0."""
    folded = fold_accents(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))

    def hits(text, phrases):
        count = lambda p: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(p)))) / F.lit(len(p.encode()))
        counts = [F.when(F.contains(text, F.lit(p)), count(p)).otherwise(F.lit(0.0)) for p in phrases]  # most phrases are in few texts, and to look is quick
        return sum(counts[1:], counts[0]).cast("int")

    def choice(counts):
        best = F.array_max(counts)
        clear = (best > 0) & (F.size(F.filter(counts, lambda c: c == best)) == 1)
        return F.when(clear, F.array_position(counts, best).cast("int") - 1).otherwise(F.lit(UNCLEAR))

    counted = let(folded, lambda text: F.array(*[hits(text, CATEGORY_PHRASES[k]) for k in sorted(CATEGORY_PHRASES)]))
    return F.when(F.contains(fold_accents(F.coalesce(jurisdiction, F.lit(""))), F.lit("droit")), F.lit(0)).otherwise(let(counted, choice))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
