"""English analysis for keyword search: stop words out, the rest stemmed."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Common English words that are not indexed.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why
    how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words with a stem of their own, and words that are done after the plural is gone.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
SINGULAR = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Beginnings after which the first region starts, doubled letters, and letters before a removable -li.
REGION_AFTER = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
# Suffixes of the second step and what takes their place in the first region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
# The same of the third step; -ative goes in the second region only.
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
# Suffixes that the fourth step removes in the second region.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len) if word.endswith(tuple(suffixes)) else None


def _after(word: str, start: int) -> int:
    """Where a region starts: after the first vowel and what is no vowel behind it."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _past(word: str, r1: int) -> str:
    """Without -ed, -ing and their adverbs."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    base = word[: -len(end)]
    if end.startswith("ee"):
        return base + "ee" if len(base) >= r1 else word
    if not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT.search(base) else base


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word by the later English algorithm (regions R1 and R2); others stay as they are."""
    w = word.removeprefix("'")
    if len(word) < 3 or not word.isascii():
        return word
    if w in WHOLE:
        return WHOLE[w]
    # y is no vowel at the beginning and behind a vowel
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    head = next((x for x in REGION_AFTER if w.startswith(x)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    end = _longest(w, ("'", "'s", "'s'"))
    w = w[: -len(end)] if end else w
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in SINGULAR:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[:-3].endswith("l")) and (end != "li" or w[:-2][-1:] in BEFORE_LI and w[:-2]):
        w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(text: str) -> list[str]:
    """The lexemes of a query, each once."""
    found = [stem(w) for w in re.findall(r"\w+", text.lower()) if w not in STOP_WORDS]
    return list(dict.fromkeys(found))


def english_tokens(texts: pa.Array) -> pa.ListArray:
    """The lexemes of each text in order; a word is stemmed once for all its places."""
    words = [re.findall(r"\w+", (x or "").lower()) for x in texts.to_pylist()]
    named = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
    # stop words keep their place as an empty lexeme, so distances count them
    stems = pa.array(["" if w in STOP_WORDS else stem(w) for w in named.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, words), initial=0)), pa.int32()), stems.take(named.indices))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexemes(texts: pd.Series) -> pd.Series:
    return pd.Series(english_tokens(pa.array(texts, pa.string())).to_pylist())


def english_lexemes(text: Column) -> Column:
    """Stemmed lexemes in order; an empty one stands for each stop word."""
    return _lexemes(text)
