"""Scalar functions on strings, times, music and arrays, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the pitch classes. Fixed values.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_STEPS, MINOR_STEPS = [0, 2, 4, 5, 7, 9, 11], [0, 2, 3, 5, 7, 8, 10]
#: What people write for no genre. Fixed values.
PLACEHOLDERS = ["", "unknown", "no idea", "other", "none", "misc"]


def is_placeholder(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(PLACEHOLDERS)


def without_brackets(x: Column, depth: int = 3) -> Column:
    """Text in brackets removed, up to `depth` levels, blanks collapsed."""
    for _ in range(depth):
        x = F.regexp_replace(x, r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def main_artist(x: Column) -> Column:
    """The name before a guest mark."""
    return F.trim(F.get(F.split(x, r"(?i)\s+(?:feat\.?|ft\.?|featuring|with)\s+|\s*[,;&]\s*"), 0))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_file_name(x: Column) -> Column:
    """Without characters that file systems refuse, and without dots or blanks at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(x, r'[\\/:*?"<>|\x00-\x1f]', "")), r"[. ]+$", "")


def first_year(x: Column) -> Column:
    """The first number of four digits, else the input."""
    year = F.regexp_extract(x, r"\b(\d{4})\b", 1)
    return F.when(year != "", year).otherwise(x)


def strip_punctuation(x: Column) -> Column:
    return F.translate(x, ".,", "")


def plain_number(x: Column, places: int = 2) -> Column:
    """A number in decimal notation without trailing zeros."""
    fixed = F.format_string(f"%.{places}f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def comma_decimal(x: Column) -> Column:
    """A number typed with a comma or a point; null if it is none."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def parse_clock(x: Column) -> Column:
    """Seconds of `S`, `M:SS` or `H:MM:SS`; null where a minute or second is 60 or more or it is no time."""
    parts = F.split(x, ":")
    n = F.size(parts)
    number = lambda i: F.get(parts, i).try_cast("double")
    valid = x.rlike(r"^\d+(\.\d+)?$|^\d+:\d{2}(\.\d+)?$|^\d+:\d{2}:\d{2}(\.\d+)?$")
    value = F.when(n == 1, number(0)).when((n == 2) & (number(1) < 60), number(0) * 60 + number(1)).when((n == 3) & (number(1) < 60) & (number(2) < 60), number(0) * 3600 + number(1) * 60 + number(2))
    return F.when(valid, value)


def clock(seconds: Column) -> Column:
    """`M:SS`, or `H:MM:SS` from an hour on."""
    s = F.floor(seconds).cast("long")
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s >= 3600, long).otherwise(short)


def beat_seconds(beat: Column, bpm: Column, gap_ms: Column) -> Column:
    """When a beat falls: four beats to a quarter at `bpm`."""
    return gap_ms / 1000 + beat * 60 / (4 * bpm)


def seconds_beat(seconds: Column, bpm: Column, gap_ms: Column) -> Column:
    return F.bround((seconds - gap_ms / 1000) * bpm * 4 / 60).cast("long")


def bpm_multiplier(bpm: Column) -> Column:
    """The largest k with k times bpm below 400; 0 from 400 on."""
    return F.greatest(F.lit(0), F.ceil(F.lit(400.0) / bpm) - 1)


def hz_midi(hz: Column) -> Column:
    return F.when(hz > 0, F.bround(F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0)).cast("int"))


def midi_name(midi: Column) -> Column:
    """`C4` for 60."""
    return F.concat(F.get(F.array(*[F.lit(n) for n in NOTES]), F.pmod(midi, F.lit(12))), (F.floor(midi / 12) - 1).cast("string"))


def fold_octaves(pitch: Column, reference: Column, tolerance: int) -> Column:
    """The pitch moved by whole octaves toward the reference where it is further off than the tolerance."""
    return F.when(F.abs(pitch - reference) > tolerance, pitch - 12 * F.bround((pitch - reference) / 12)).otherwise(pitch)


def pull_unsure(pitch: Column, reference: Column, sure: Column, least: float = 0.3, most: float = 3) -> Column:
    """An unsure pitch moved halfway toward the reference, at most `most`."""
    step = F.least(F.lit(most), F.greatest(F.lit(-most), (reference - pitch) / 2))
    return F.when(sure < least, F.bround(pitch + step)).otherwise(pitch)


def nearest_in_key(midi: Column, tonic: Column, minor: Column) -> Column:
    """The nearest pitch of the scale; of two as near, the lower."""
    offsets = sorted(range(-6, 7), key=lambda d: (abs(d), d))
    pc = lambda d: F.pmod(midi + d - tonic, F.lit(12))
    out = midi
    for d in reversed(offsets):
        fits = F.when(minor == 1, pc(d).isin(MINOR_STEPS)).otherwise(pc(d).isin(MAJOR_STEPS))
        out = F.when(fits, midi + d).otherwise(out)
    return out


def natural_length(word: Column) -> Column:
    """How long a word takes to sing, about."""
    return 0.1 + 0.06 * F.length(word)


def quarter_length(beats: Column) -> Column:
    """To the nearest quarter, half to even, a quarter at least."""
    return F.greatest(F.lit(0.25), F.bround(beats * 4) / 4)


def split_evenly(start: Column, end: Column, n: Column) -> Column:
    """n equal stretches from start to end, as an array of structs."""
    step = (end - start) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + step * i).alias("start"), (start + step * (i + 1)).alias("end")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def key_values(line: Column) -> Column:
    """The `key=value` marks of a log line as a map; a repeated key keeps its last value."""
    keys = F.regexp_extract_all(line, F.lit(r"([A-Za-z_]\w*)=(\S+)"), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r"([A-Za-z_]\w*)=(\S+)"), F.lit(2))
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.size(keys)), x["k"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: F.get(values, x["i"])))


def script_of(text: Column) -> Column:
    """`cyrillic`, `hangul`, `japanese`, `chinese` or `latin`, the first that the text shows any character of."""
    return (
        F.when(text.rlike(r"[\x{3040}-\x{30FF}]"), "japanese")
        .when(text.rlike(r"[\x{AC00}-\x{D7AF}]"), "hangul")
        .when(text.rlike(r"[\x{0400}-\x{04FF}]"), "cyrillic")
        .when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "chinese")
        .when(text.rlike("[A-Za-z]"), "latin")
    )


def octave_distance(a: Column, b: Column) -> Column:
    """How far two pitches are apart within the octave."""
    d = F.pmod(a - b, F.lit(12))
    return F.least(d, 12 - d)


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step, from the highest on, that a value reaches."""
    out = None
    for least, name in sorted(steps, reverse=True):
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
