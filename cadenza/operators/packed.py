"""Several values packed in one field.

Quoted spans and names that are one value whatever characters they hold are
replaced by indexed placeholders, the rest is split at the delimiters, the
spans come back by array lookup, and the pieces are exploded with positions.
Everything is a built-in expression, so the split stays in the JVM and
needs no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = ",;/|\\\\\n\r\t·•"
#: Stripped from the ends of every piece, along with blanks.
WRAPPERS = "\"“”„«»\\[\\]"
#: Open and close a placeholder. Either character found in the data is itself taken out as a span, so none collides.
OPEN, CLOSE = "\ue000", "\ue001"


def _java_quote(name: str) -> str:
    """A regular expression for `name`, with any run of blanks where it has one."""
    return r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", word) for word in name.split())


def span_pattern(names: list[str]) -> str:
    """What a placeholder stands for: a quoted span that begins and ends a value, a protected name, a stray placeholder character."""
    quoted = rf'(?<=^|[\s\[{DELIMITERS}])"(?:[^"]|"")*"(?=$|[\s\]{DELIMITERS}])'
    protected = sorted({n for n in names if n and re.search(rf"[{DELIMITERS}]", n)}, key=lambda n: (-len(n), n))
    known = [rf"(?<![\p{{L}}\p{{N}}])(?iu:{_java_quote(n)})(?![\p{{L}}\p{{N}}])" for n in protected]
    return "|".join([*known, quoted, f"[{OPEN}{CLOSE}]"])


def split_packed(value: Column, names: list[str]) -> Column:
    """The values packed in `value`, an array of trimmed, non-empty strings.

    value: a string column; null gives null, a blank or delimiter-only string
    an empty array. names: names that are one value even where they hold a
    delimiter; only those with one matter. A quote without a partner is an
    ordinary character, stripped at the ends of a piece only.
    """
    pattern = F.lit(span_pattern(names))
    spans = F.regexp_extract_all(value, pattern, F.lit(0))
    outside = F.split(value, span_pattern(names), -1)
    masked = F.array_join(
        F.transform(outside, lambda part, i: F.when(i < F.size(outside) - 1, F.concat(part, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(part)),
        "",
    )

    def restored(piece: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(piece, OPEN, -1),
                lambda part, i: F.when(i == 0, part).otherwise(
                    F.concat(F.element_at(spans, F.substring_index(part, CLOSE, 1).cast("int") + 1), F.substring_index(part, CLOSE, -1))
                ),
            ),
            "",
        )

    return F.filter(F.transform(F.split(masked, f"[{DELIMITERS}]", -1), lambda piece: bare(restored(piece))), lambda piece: piece != "")


def bare(piece: Column) -> Column:
    """`piece` without blanks, quotes or square brackets around it."""
    edge = rf"[\s\p{{Z}}{WRAPPERS}]+"
    return F.regexp_replace(F.regexp_replace(piece, f"^{edge}", ""), f"{edge}$", "")


def explode_packed(df: DataFrame, value: str, names: list[str], *, keep: list[str], least: int = 1, pos: str = "pos", piece: str = "piece") -> DataFrame:
    """One row per packed value: the `keep` columns, its position from 0, and the value.

    least: fields with fewer values are left out (2: only packed fields).
    Nulls and blanks give no rows; repeated input rows give repeated rows.
    """
    packed = df.select(*[F.col(k) for k in keep], split_packed(F.col(f"`{value}`"), names).alias("__packed"))
    return packed.where(F.size("__packed") >= least).select(*[F.col(k) for k in keep], F.posexplode("__packed").alias(pos, piece))
