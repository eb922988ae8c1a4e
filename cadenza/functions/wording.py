"""Functions on wordings: lists as typed, names of things in other letters, numbers in words, hyphens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Russian letters as readers of English expect them. Fixed values.
RUSSIAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: What the genres of a slashed list can share at its end. Fixed values.
NOUNS = ["metal", "rock", "punk", "pop", "core", "music"]
#: How files of images begin. Fixed values.
IMAGES = [("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638")]


def capitalised(x: Column) -> Column:
    """The first letter upper case, the others lower case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def title_cased_list(x: Column) -> Column:
    """A list separated by commas, semicolons or slashes, each value and each part between its hyphens capitalised; blank ones are left out."""
    values = F.filter(F.split(x, "[;/,]"), lambda v: F.trim(v) != "")
    return F.array_join(F.transform(values, lambda v: F.array_join(F.transform(F.split(v, "-"), lambda p: capitalised(F.trim(p))), "-")), ", ")


def shared_noun_genres(x: Column) -> Column:
    """The genres of a text such as `Melodic Death/Black Metal (early); Folk`, lower case, each once: remarks in brackets go, and what is slashed shares the last one's noun."""
    items = F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"\([^)]*\)", " "), "[;,]")
    word = lambda t: F.element_at(F.split(t, " "), -1)

    def spread(item: Column) -> Column:
        parts = F.filter(F.transform(F.split(item, "/"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " "))), lambda p: p != "")
        noun = word(F.coalesce(F.element_at(parts, -1), F.lit("")))
        return F.transform(parts, lambda p, i: F.when((i == F.size(parts) - 1) | word(p).isin(NOUNS) | ~noun.isin(NOUNS), p).otherwise(F.concat(p, F.lit(" "), noun)))

    return F.array_distinct(F.flatten(F.transform(F.filter(items, lambda i: F.regexp_replace(i, r"[/\s]", "") != ""), spread)))


def romanised_russian(x: Column) -> Column:
    """Russian letters in Latin ones, signs left out; a capital stays one, and a text all in capitals is so in Latin too."""
    table = F.create_map(*[F.lit(v) for pair in RUSSIAN.items() for v in pair])
    each = F.transform(F.split(x, ""), lambda c: F.when(table[F.lower(c)].isNull(), c).when(c != F.lower(c), capitalised(table[F.lower(c)])).otherwise(table[c]))
    out, letters = F.array_join(each, ""), F.regexp_replace(x, r"\P{L}", "")
    return F.when((F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters)), F.upper(out)).otherwise(out)


def cyrillic_language(x: Column) -> Column:
    """`ua` if a text holds a letter that only Ukrainian has, else `ru`."""
    return F.when(x.rlike("[іїєґІЇЄҐ]"), "ua").otherwise("ru")


def language_code(x: Column) -> Column:
    """A code of two letters in lower case, blank for anything else."""
    low = F.lower(F.trim(x))
    return F.when(low.rlike("^[a-z]{2}$"), low).otherwise("")


def styles(x: Column, known: list[str], neutral: list[str]) -> tuple[Column, Column]:
    """The known and the unknown ones of a list of styles: lower case, blanks as underscores, each once and in order, neutral ones left out."""
    words = F.transform(F.split(x, ","), lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\s+", "_"))
    found = F.array_sort(F.array_distinct(F.filter(words, lambda v: (v != "") & ~v.isin(neutral))))
    known_ones = F.array(*[F.lit(k) for k in known])
    return F.array_intersect(found, known_ones), F.array_except(found, known_ones)


def image_kind(content: Column) -> Column:
    """`jpg`, `png`, `gif` or `webp` by how a file begins, null for others."""
    start = F.hex(F.substring(content, 1, 12))
    kind = F.when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "webp")
    for name, magic in IMAGES:
        kind = kind.when(start.startswith(magic), name)
    return kind


def nearest_word(x: Column, words: list[str], *, most: int = 10_000) -> Column:
    """The word of a list with the smallest edit distance, of equally near ones the first in order. The list is a literal of the plan, so its length is checked."""
    if len(words) > most:
        raise ValueError(f"{len(words)} words are too many for a literal")
    listed = F.array(*[F.lit(w) for w in sorted(set(words))])
    return F.array_min(F.transform(listed, lambda w: F.struct(F.levenshtein(x, w).alias("d"), w.alias("w"))))["w"]


def drop_page_artefacts(lines: Column) -> Column:
    """An array of lines without a page's title line at the start (`... Lyrics`) and its button at the end (`12Embed`)."""
    first = F.lower(F.get(lines, 0)).endswith("lyrics")
    rest = F.when(first, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
    last = F.get(rest, F.size(rest) - 1).rlike(r"(?i)\d*\s*embed$")
    return F.when(last, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)


#: Words for numbers: below twenty, tens, hundred, thousand, million. Fixed values.
UNITS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(),
}
TENS = {"en": "twenty thirty forty fifty sixty seventy eighty ninety".split(), "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()}


def english(n: int) -> str:
    if n < 20:
        return UNITS["en"][n]
    if n < 100:
        return TENS["en"][n // 10 - 2] + (f"-{english(n % 10)}" if n % 10 else "")
    if n < 1000:
        return f"{english(n // 100)} hundred" + (f" and {english(n % 100)}" if n % 100 else "")
    size, name = (1_000_000, "million") if n >= 1_000_000 else (1000, "thousand")
    rest = n % size
    return f"{english(n // size)} {name}" + (("" if not rest else f" and {english(rest)}" if rest < 100 else f", {english(rest)}"))


def german(n: int, one: str = "eins") -> str:
    if n < 20:
        return one if n == 1 else UNITS["de"][n]
    if n < 100:
        return (f"{german(n % 10, 'ein')}und" if n % 10 else "") + TENS["de"][n // 10 - 2]
    if n < 1000:
        return f"{german(n // 100, 'ein')}hundert" + (german(n % 100) if n % 100 else "")
    if n < 1_000_000:
        return f"{german(n // 1000, 'ein')}tausend" + (german(n % 1000) if n % 1000 else "")
    return ("eine Million" if n < 2_000_000 else f"{german(n // 1_000_000)} Millionen") + (f" {german(n % 1_000_000)}" if n % 1_000_000 else "")


SPOKEN = {"en": english, "de": german}


def numbers_in_words(text: str | None, language: str) -> str | None:
    """Whole numbers of up to nine digits that stand alone, in words; other texts and languages stay."""
    if text is None or language not in SPOKEN:
        return text
    return re.sub(r"(?<![\w.,])\d{1,9}(?![\w]|[.,]\d)", lambda m: SPOKEN[language](int(m[0])), text)


@F.pandas_udf(T.StringType())
def in_words(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([numbers_in_words(t, g) for t, g in zip(texts, languages, strict=True)], dtype=object)


class Hyphens:
    """Hyphenation by patterns: digits between letters weigh breaks, the largest of all patterns that match wins, and odd ones allow a break."""

    def __init__(self, patterns: list[str], left: int = 2, right: int = 2):
        self.left, self.right = left, right
        self.weights = {re.sub(r"\d", "", p): [int(d or 0) for d in re.split(r"[^\d]", p)] for p in patterns}
        self.longest = max(map(len, self.weights), default=0)

    def parts(self, word: str) -> list[str]:
        marked = f".{word.lower()}."
        best = [0] * (len(marked) + 1)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + self.longest) + 1):
                for k, weight in enumerate(self.weights.get(marked[i:j], ())):
                    best[i + k] = max(best[i + k], weight)
        cuts = [i for i in range(self.left, len(word) - self.right + 1) if best[i + 1] % 2]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def __call__(self, token: str | None) -> list[str] | None:
        """The syllables of a token; what isn't a letter stays where it was."""
        if token is None:
            return None
        letters = "".join(c for c in token if c.isalpha())
        out, at = [], 0
        for n, part in enumerate(parts := self.parts(letters)):
            taken, text = 0, ""
            while at < len(token) and (taken < len(part) or n == len(parts) - 1 or not token[at].isalpha()):
                taken += token[at].isalpha()
                text += token[at]
                at += 1
            out.append(text)
        return out


def hyphenated(x: Column, patterns: list[str]) -> Column:
    """The syllables of words as an array, by patterns that are a parameter."""
    hyphens = Hyphens(patterns)
    return F.pandas_udf(lambda s: s.map(hyphens), T.ArrayType(T.StringType()), functionType=F.PandasUDFType.SCALAR)(x)
