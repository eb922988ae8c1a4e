"""Mapping free-entered values to a canonical list.

A symmetric-delete dictionary of the list is broadcast; each distinct value
is looked up at edit distance 0, 1, 2 in turn, and candidates are ranked by
weighted Damerau-Levenshtein distance and reference frequency. Values without
a match are reported with id 0.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.spelling import deletes, osa, plain, squeezed, weighted
from cadenza.session import share

#: What people put around a value without changing its meaning. Fixed patterns.
DECORATIONS = [r"^(?:mostly|mainly)\s+", r"^~\s*", r"^(?:genre|style)\s*:\s*", r"\s*\((?:style|genre)\)$", r"[\s]*[!.?]+$", r"[\s-]+(?:music|songs?|style)$"]
#: Other names of genres, as common knowledge has them; a parameter of the operator. Fixed values.
GENRE_ALIASES = {
    "rock music": "Rock", "rockmusik": "Rock", "pop music": "Pop", "popmusik": "Pop", "folklore": "Folk", "c&w": "Country", "country & western": "Country",
    "country and western": "Country", "tekkno": "Techno", "klassik": "Classical", "classique": "Classical", "música clásica": "Classical", "ost": "Soundtrack",
    "filmmusik": "Soundtrack", "movie soundtrack": "Soundtrack", "film music": "Soundtrack", "banda sonora": "Soundtrack", "showtunes": "Musical",
    "show tunes": "Musical", "broadway style": "Musical", "broadway": "Musical", "rnb": "R&B", "r and b": "R&B", "r'n'b": "R&B", "rhythm and blues": "R&B", "rhythm & blues": "R&B",
    "dnb": "Drum & Bass", "d&b": "Drum & Bass", "drum and bass": "Drum & Bass", "drum n bass": "Drum & Bass", "drum'n'bass": "Drum & Bass", "hip hop music": "Hip-Hop",
    "shanty": "Sea Shanty", "shanties": "Sea Shanty", "lullabies": "Lullaby", "wiegenlied": "Lullaby", "canción de cuna": "Lullaby", "xmas": "Christmas",
    "weihnachten": "Christmas", "navidad": "Christmas", "noël": "Christmas", "kids": "Children's Music", "kids songs": "Children's Music", "kinderlieder": "Children's Music",
    "childrens songs": "Children's Music", "liedermacher": "Singer-Songwriter", "cantautor": "Singer-Songwriter", "synthie pop": "Synth-Pop", "goth": "Gothic",
    "neue welle": "New Wave", "alt rock": "Alternative Rock", "alt. rock": "Alternative Rock", "rock alternativo": "Alternative Rock", "prog rock": "Progressive Rock",
    "prog metal": "Progressive Metal", "rock n roll": "Rock and Roll", "rock'n'roll": "Rock and Roll", "r'n'r": "Rock and Roll", "rock & roll": "Rock and Roll",
    "weltmusik": "World Music", "ez listening": "Easy Listening", "humour": "Comedy", "humor": "Comedy", "funny": "Comedy", "vgm": "Video Game Music", "game ost": "Video Game Music",
    "slow waltz": "Waltz, Slow", "comic opera": "Opera, Comic", "neo classical": "Neoclassical", "a capella": "A Cappella", "acapella": "A Cappella",
}
#: Letters and digits a value needs before one, and before two, slips are allowed.
LEAST_FOR = {0: 1, 1: 4, 2: 9}


class Dictionary:
    """The reference list by every key that a few deletions leave of an entry or of one of its other names."""

    def __init__(self, entries: list[tuple[int, str, int]], aliases: dict[str, str]):
        self.frequency = {i: n for i, _, n in entries}
        self.exact: dict[str, int] = {}
        self.near: dict[str, list[tuple[str, int]]] = defaultdict(list)
        by_name = {plain(name): i for i, name, _ in entries if name}
        keys = [(squeezed(name), i) for i, name, _ in entries if name]
        keys += [(squeezed(other), by_name[plain(name)]) for other, name in aliases.items() if plain(name) in by_name]
        self.longest = max((len(k) for k, _ in keys), default=0)
        for key, i in keys:
            if key and self.exact.setdefault(key, i) == i:
                for left in deletes(key, self.slips(key)):
                    if (key, i) not in self.near[left]:
                        self.near[left].append((key, i))

    @staticmethod
    def slips(key: str) -> int:
        return max(d for d, least in LEAST_FOR.items() if len(key) >= least or d == 0)

    @staticmethod
    def forms(typed: str) -> list[str]:
        """The value as typed, then with what people put around it taken off, one layer at a time."""
        out, text = [typed], typed
        changed = True
        while changed:
            changed = False
            for pattern in DECORATIONS:
                less = re.sub(pattern, "", text, flags=re.IGNORECASE).strip()
                if less and less != text:
                    text, changed = less, True
                    out.append(text)
        return list(dict.fromkeys(out))

    def find(self, typed: str | None) -> tuple[int, float | None]:
        """The id of the entry that the value means and the weighted distance, or (0, None)."""
        keys = list(dict.fromkeys(k for f in self.forms(typed or "") if (k := squeezed(f))))
        for key in keys:
            if key in self.exact:
                return self.exact[key], 0.0
        for depth in (1, 2):
            found = {}
            for key in keys:
                if self.slips(key) < depth or len(key) > self.longest + depth:  # no entry can be that near
                    continue
                for left in deletes(key, depth):
                    for other, i in self.near.get(left, ()):
                        if self.slips(other) >= depth and osa(key, other, depth) <= depth:
                            found[i] = min(found.get(i, 99.0), weighted(key, other))
            if found:
                best = min(found, key=lambda i: (found[i], -self.frequency[i], i))
                return best, found[best]
        return 0, None


def map_to_reference(values: DataFrame, value: str, reference: DataFrame, ref_id: str, ref_name: str, *, aliases: dict[str, str], most_keys: int = 2_000_000) -> DataFrame:
    """Each distinct value once: `typed`, `n` (rows with it), `ref_id` (0: none), `distance` (null: none).

    Nulls and blank values are left out. Case, accents, blanks, hyphens and
    punctuation make no difference; what is left may differ by one slip from
    four letters on, by two from nine on. Ties go to the smaller weighted
    distance, then to the entry that occurs more often as such among the
    values, then to the smaller id. The symmetric-delete dictionary is built
    once and broadcast; the keys that the list's names would leave are counted
    before anything is collected and may be `most_keys`, some 200 MB. Values
    are only counted (combined before the shuffle), whatever their number. An
    empty reference list maps everything to 0.
    """
    spark = values.sparkSession
    named = reference.select(ref_id, ref_name).where(F.col(ref_name).isNotNull())
    letters = F.length(ref_name)
    keys = named.agg(F.sum(1 + letters + letters * (letters - 1) / 2).alias("n")).first()["n"] or 0
    if keys > most_keys:
        raise ValueError(f"the reference list would leave {keys:.0f} keys, more than the {most_keys} that may be sent to every task")
    entries = named.collect()
    spellings = values.select(F.col(value).alias("typed")).where(F.col(value).rlike(r"[^\s\p{Z}]")).groupBy("typed").agg(F.count(F.lit(1)).alias("n"))
    plainly = F.broadcast(named.select(F.col(ref_id).alias("ref_id"), F.lower(ref_name).alias("__name")))  # not more than the keys checked above
    frequency = {r.ref_id: r.n for r in spellings.join(plainly, F.lower("typed") == F.col("__name")).groupBy("ref_id").agg(F.sum("n").alias("n")).collect()}
    shared = share(spark, Dictionary([(r[0], r[1], frequency.get(r[0], 0)) for r in entries], aliases))

    @F.pandas_udf("ref_id int, distance double")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dictionary = shared.value
        for typed in batches:
            yield pd.DataFrame([dictionary.find(t) for t in typed], columns=["ref_id", "distance"])

    return spellings.withColumn("__found", look_up("typed")).select("typed", "n", "__found.ref_id", "__found.distance")
