"""English stemming by the published Snowball (Porter 2) rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_V = "[aeiouy]"


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and the second syllable begin."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        found = re.search(f"{_V}[^aeiouy]", word)
        start = found.end() if found else len(word)
    found = re.compile(f"{_V}[^aeiouy]").search(word, start)
    return start, found.end() if found else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and re.search(f"(?:^{_V}[^aeiouy]|[^aeiouy]{_V}[^aeiouywxY])$", word) is not None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(f"(?<={_V})y", "Y", word)
    word = "Y" + word[1:] if word[0] == "y" else word
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in UNCHANGED:
        return word
    if m := re.search("(eedly|eed)$", word):
        word = word[: m.start()] + "ee" if m.start() >= r1 else word
    elif (m := re.search("(ingly|edly|ing|ed)$", word)) and re.search(_V, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif _short(word, r1):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for end in sorted([*STEP_2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1:
                if end == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif end == "li":
                    word = word[:-2] if word[at - 1 : at] and word[at - 1] in "cdeghkmnrt" else word
                else:
                    word = word[:at] + STEP_2[end]
            break
    for end in sorted([*STEP_3, "ative"], key=len, reverse=True):
        if word.endswith(end):
            at = len(word) - len(end)
            if end == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + STEP_3[end]
            break
    for end in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1], 0 if len(word) - 1 < r1 else len(word) - 1)):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(tokens: Column) -> Column:
    """Each token's stem."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(tokens)
