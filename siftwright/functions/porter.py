"""Stems of English words by the suffix-stripping algorithm of Porter (1980)."""

from __future__ import annotations

from functools import lru_cache

#: The paper's suffixes and what replaces them. In steps 2 and 3 the
#: stem must have a measure above 0, in step 4 above 1.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c for a consonant and v for a vowel, letter by letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix that fits decides, whether its stem allows it or not."""
    for size in range(min(7, len(word)), 0, -1):
        if (end := word[-size:]) in rules:
            stem = word[:-size]
            return stem + rules[end] if measure(stem) >= least else word
    return word


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in shape(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")) or measure(word) == 1 and short_end(word):
                        word += "e"
                    elif shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                        word = word[:-1]
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP2, 1), STEP3, 1)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not short_end(rest):
            word = rest
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
