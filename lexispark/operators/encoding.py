"""Inputs and heads of a pair model as array columns: token ids, encoded pairs, masks, choice and rubric outputs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, normalize, sigmoid

# Special tokens, letters and words of the character vocabulary, in the order of their ids.
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
LETTERS = "".join(map(chr, range(32, 127))) + "éèêëàâäôöûüçîïÉÈÊËÀÂÄÔÖÛÜÇÎÏ«»—–’'°%€$£"
STEMS = """
oui non aucun aucune pas jamais sans ne allergie allergique traitement posologie patient dossier antécédent diagnostic
ordonnance médicament chirurgie bilan yes no not none never without allergy patient date nom prix statut clause contrat
article loi vrai faux pertinent trouvé score recherche texte
""".split()


def character_vocabulary(special: Iterable[str] = SPECIAL, letters: Iterable[str] = LETTERS, stems: Iterable[str] = STEMS) -> dict[str, int]:
    """Ids of the special tokens, the letters and every beginning of the stems, in this order, each once."""
    pieces = [*special, *letters, *(w[: k + 1] for w in stems for k in range(len(w)))]
    return {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}


def _lookup(ids: dict) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in ids]), F.array(*[F.lit(v) for v in ids.values()]))


def token_ids(text: Column, vocabulary: dict[str, int], special: tuple[str, ...] = SPECIAL, unknown: str = "[UNK]") -> Column:
    """Ids of the longest pieces of the vocabulary that each word is made of, from its front on; a null has none.

    Text is in lower case; words are runs of letters, digits and apostrophes, and every other sign is one of its own.  A
    character that no piece begins with is the unknown token.
    """
    pieces = sorted((p for p in vocabulary if p not in special), key=lambda p: (-len(p), p))
    longest_first = "|".join(map(re.escape, pieces))
    words = F.regexp_extract_all(normalize(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_']+|[^\p{L}\p{N}_\s]"), F.lit(0))
    cut = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"(?s){longest_first}|."), F.lit(0))))
    known = _lookup({p: vocabulary[p] for p in pieces})
    return F.transform(cut, lambda p: F.coalesce(F.element_at(known, p), F.lit(vocabulary[unknown])))


def decoded(ids: Column, vocabulary: dict[str, int], special: tuple[str, ...] = SPECIAL) -> Column:
    """Text of token ids without the special ones; ids beyond the vocabulary give nothing."""
    known = _lookup({k: p for p, k in vocabulary.items() if p not in special})
    return F.array_join(F.filter(F.transform(ids, lambda k: F.element_at(known, k)), lambda p: p.isNotNull()), "")


def pair_ids(query: Column, text: Column, first: int, separator: int, most: int = 256, most_query: int = 64) -> Column:
    """Start, query, separator, text, separator, from arrays of token ids; the query keeps at most 64, the whole 256."""
    asked = F.slice(F.coalesce(query, F.array().cast("array<int>")), 1, most_query)
    given = F.coalesce(text, F.array().cast("array<int>"))
    room = F.greatest(F.lit(0), F.lit(most - 3) - F.size(asked))
    whole = F.concat(F.array(F.lit(first)), asked, F.array(F.lit(separator)), F.slice(given, F.lit(1), room), F.array(F.lit(separator)))
    return F.slice(whole, 1, most)


def padded(ids: Column, length: int | Column, pad: int = 0) -> Column:
    """Struct of ids filled up to the length, and a mask that is 1 for the ids given."""
    size = length if isinstance(length, Column) else F.lit(length)
    fill = F.greatest(F.lit(0), size - F.size(ids))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill)).alias("mask"))


def choice(logits: Column, options: int) -> Column:
    """Struct of the best of the first ``options`` labels (from 0, the first of equal ones) and its softmax share."""

    def shares(values):
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return F.struct((F.array_position(values, top).cast("int") - 1).alias("index"), (1.0 / total).alias("probability"))

    return let(F.slice(F.transform(logits, lambda v: v.cast("double")), 1, options), shares)


def rubric(logit: Column) -> Column:
    """Score from 0 to 4."""
    return 4.0 * sigmoid(logit)
