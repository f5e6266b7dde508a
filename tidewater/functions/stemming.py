"""The English stemmer of the published Snowball algorithm ("Porter2"), for single words on the executors."""

from __future__ import annotations

from functools import lru_cache

#: The algorithm's letters, doubles, exceptions and suffix tables.
VOWELS, DOUBLES, LI_ENDINGS = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
REGIONS = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
ENDINGS_2, ENDINGS_3 = tuple(STEP_2), tuple(STEP_3)


def _after_first(word: str, begin: int) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    for i in range(begin + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _longest(word: str, suffixes: tuple[str, ...]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else ""


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of other letters than a-z and ' stay as they are."""
    if len(word) <= 2 or not all("a" <= ch <= "z" or ch == "'" for ch in word):
        return word
    word = word.removeprefix("'")
    if word in WHOLE:
        return WHOLE[word]
    word = "".join("Y" if ch == "y" and (i == 0 or word[i - 1] in VOWELS) else ch for i, ch in enumerate(word))
    r1 = next((len(p) for p in REGIONS if word.startswith(p)), None) or _after_first(word, 0)
    r2 = _after_first(word, r1)
    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))
    # plurals
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and any(ch in VOWELS for ch in word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURALS:
        return word
    # participles and adverbs of them
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word.removesuffix(ending) + "ee"
    elif ending and any(ch in VOWELS for ch in word[: -len(ending)]):
        word = word.removesuffix(ending)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    ending = _longest(word, ENDINGS_2)
    if ending and len(word) - len(ending) >= r1:
        before = word.removesuffix(ending)
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before[-1:] in tuple(LI_ENDINGS)):
            word = before + STEP_2[ending]
    ending = _longest(word, ENDINGS_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word.removesuffix(ending) + STEP_3[ending]
    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word.removesuffix(ending)
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
