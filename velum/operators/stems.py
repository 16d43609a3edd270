"""English stems by the published Snowball rules (Porter2), and the stop words of full-text search."""

from __future__ import annotations

import re

# Stop words, suffix rules, and words that are exceptions to them.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not only own same so than
    too very s t can will just don should now""".split()
)
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_region = re.compile(r"[aeiouy][^aeiouy]")
_vowel = re.compile(r"[aeiouy]")
_short = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_double = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after(word: str, start: int) -> int:
    """Where the region behind the first consonant that follows a vowel, from `start` on, begins."""
    found = _region.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; one of two letters or less stays."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)  # y as a consonant
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _after(word, 0)
    r2 = _after(word, r1)
    word = _plural(word)
    if word in SETTLED:
        return word
    word = _tense(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _vowel.match(word[-2]):
        word = word[:-1] + "i"
    suffix = _longest(word, STEP2)
    if suffix and len(word) - len(suffix) >= r1:
        bare = word[: -len(suffix)]
        if not (suffix == "ogi" and not bare.endswith("l")) and not (suffix == "li" and bare[-1:] not in tuple("cdeghkmnrt")):
            word = bare + STEP2[suffix]
    suffix = _longest(word, STEP3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(word, STEP4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _vowel.search(word[:-2]):
        return word[:-1]
    return word


def _tense(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    if not suffix or not _vowel.search(word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double.search(word):
        return word[:-1]
    return word + "e" if len(word) <= r1 and _short.search(word) else word
