"""English stems by the published Porter2 rules, as column expressions.

Each step is one ordered expression over a word: the longest ending that fits decides, whether or not its condition holds.
A condition on R1 or R2 says how many times a vowel and a non-vowel after it stand before the ending. Steps are
transformations of an array one after the other, so that each refers to the word before it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters, endings and exceptions of the rules; Y is a y that is no vowel.
V, C = "[aeiouy]", "[^aeiouy]"
DOUBLES, LI_AFTER = "bb|dd|ff|gg|mm|nn|pp|rr|tt", "cdeghkmnrt"
EARLY_R1 = "gener|commun|arsen"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

#: A word whose R1 (R2) starts before what follows.
R1 = f"^(?:(?:{EARLY_R1}).*|(?!{EARLY_R1}).*{V}{C}.*)"
R2 = f"^(?:(?:{EARLY_R1}).*{V}{C}.*|(?!{EARLY_R1}).*?{V}{C}.*{V}{C}.*)"
SHORT_END = f"(?:^{V}{C}|{C}{V}[^aeiouywxY])"
SHORT_WORD = f"^(?!{EARLY_R1})(?:{V}{C}|{C}+{V}[^aeiouywxY])$"


def _ending(word: Column, endings: list[tuple[str, Callable[[Column], Column]]]) -> Column:
    """What the longest ending makes of the word; the word itself if it has none of them."""
    chain = None
    for ending, make in sorted(endings, key=lambda x: -len(x[0])):
        met = word.endswith(ending)
        chain = F.when(met, make(word)) if chain is None else chain.when(met, make(word))
    return chain.otherwise(word)


def _cut(word: Column, n: int, put: str = "") -> Column:
    kept = F.substring(word, F.lit(1), F.length(word) - n)
    return F.concat(kept, F.lit(put)) if put else kept


def _if(pattern: str, ending: str, put: str = "") -> Callable[[Column], Column]:
    """The ending replaced where the word before it fits the pattern."""
    return lambda w: F.when(w.rlike(f"{pattern}{ending}$"), _cut(w, len(ending), put)).otherwise(w)


def _consonant_y(w: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "(?<=[aeiouy])y", "Y")


def _step_1a(w: Column) -> Column:
    return _ending(w, [
        ("sses", lambda w: _cut(w, 2)), *((e, lambda w: F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))) for e in ("ied", "ies")),
        ("us", lambda w: w), ("ss", lambda w: w), ("s", lambda w: F.when(w.rlike(f"{V}.+s$"), _cut(w, 1)).otherwise(w)),
    ])


def _step_1b(w: Column) -> Column:
    def removed(ending: str) -> Callable[[Column], Column]:
        def make(w: Column) -> Column:
            stem = _cut(w, len(ending))
            mended = F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(f"(?:{DOUBLES})$"), _cut(stem, 1)).when(stem.rlike(SHORT_WORD), F.concat(stem, F.lit("e"))).otherwise(stem)
            return F.when(w.rlike(f"{V}.*{ending}$"), mended).otherwise(w)

        return make

    changed = _ending(w, [("eed", _if(R1, "eed", "ee")), ("eedly", _if(R1, "eedly", "ee")), *((e, removed(e)) for e in ("ed", "edly", "ing", "ingly"))])
    return F.when(w.isin(*AFTER_1A), w).otherwise(changed)


def _step_1c(w: Column) -> Column:
    return F.when(w.rlike(f".{C}[yY]$"), _cut(w, 1, "i")).otherwise(w)


def _step_2(w: Column) -> Column:
    own = {"ogi": _if(f"{R1}(?<=l)", "ogi", "og"), "li": _if(f"{R1}(?<=[{LI_AFTER}])", "li")}
    return _ending(w, [(e, own.get(e) or _if(R1, e, put)) for e, put in STEP_2.items()])


def _step_3(w: Column) -> Column:
    return _ending(w, [(e, _if(R2 if e == "ative" else R1, e, put)) for e, put in STEP_3.items()])


def _step_4(w: Column) -> Column:
    return _ending(w, [(e, _if(f"{R2}(?<=[st])" if e == "ion" else R2, e)) for e in STEP_4])


def _step_5(w: Column) -> Column:
    short = w.rlike(f"{SHORT_END}e$")
    return F.when(w.endswith("e"), F.when(w.rlike(f"{R2}e$") | (w.rlike(f"{R1}e$") & ~short), _cut(w, 1)).otherwise(w)).when(w.rlike(f"{R2}(?<=l)l$"), _cut(w, 1)).otherwise(w)


_STEPS = (_consonant_y, _step_1a, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5, F.lower)


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words. Words of one or two letters, and those with other letters than a to z, stay as they are."""
    now = words
    for n, step in enumerate(_STEPS):
        now = F.transform(now, _passing(step, first=n == 0, last=n == len(_STEPS) - 1))
    return now


def _passing(step: Callable[[Column], Column], first: bool, last: bool) -> Callable[[Column], Column]:
    """The step for words that take part. Exceptions and short words carry a mark that no ending fits, from the first step to the last."""
    mark = "#"

    def one(w: Column) -> Column:
        if first:
            known = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
            return F.when((F.length(w) < 3) | ~w.rlike("^[a-z]+$"), F.concat(w, F.lit(mark))).when(w.isin(*WHOLE), F.concat(F.element_at(known, w), F.lit(mark))).otherwise(step(w))
        if last:
            return F.when(w.endswith(mark), _cut(w, 1)).otherwise(step(w))
        return F.when(w.endswith(mark), w).otherwise(step(w))

    return one
