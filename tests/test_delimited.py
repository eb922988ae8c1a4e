import random
import re

from cadenza.sources.delimited import Grammar, files_of_lines, loaded, parse_files, parse_lines, rejected

NAMES = ["band", "title", "genre", "note"]
CASES = [
    ("a\tb\tc\td", None),
    ('"a\tx"\tb\tc\t"say ""hi"""', None),
    ('a\tb\tc\tone "long" one', None),
    ('"a\nb"\tb\tc\td', None),
    ('"a\tb\tc\td', "quoting"),
    ('"a"x\tb\tc\td', "quoting"),
    ('a\tb\tc\t"', "quoting"),
    ("a\tb\tc", "columns"),
    ("a\tb\tc\td\t", "columns"),
    ("", "columns"),
    (None, "columns"),
    ("  \tb\tc\td", "value"),
    (" \tb\tc\td", "value"),
    ('""\tb\tc\td', "value"),
    ("a\x07\tb\tc\td", "value"),
    ("a\tb\x07\tc\td", None),
    ("a\tb\tc\td�", "value"),
    ("a\tb\tc\td\x7f", "value"),
    ('"a\tb', "quoting"),
    ("x" * 300_000 + "\tb\tc\td", None),
]


def parsed(spark, cases):
    df = spark.createDataFrame([(i, raw, "old") for i, (raw, _) in enumerate(cases)], "id int, raw string, reason string")
    return parse_lines(df, "raw", NAMES, required=["band"], checked=["band", "note"])


def test_reasons(spark):
    assert {r.id: r.reason for r in parsed(spark, CASES).collect()} == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_cells_and_empty_table(spark):
    rows = {r.id: r for r in loaded(parsed(spark, CASES), NAMES, keep=["id"]).collect()}
    assert rows[1].band == "a\tx" and rows[1].note == 'say "hi"' and rows[2].note == 'one "long" one'
    assert rejected(parsed(spark, []), keep=["id"]).count() == 0


def test_files_resume_after_a_broken_quote(spark):
    text = 'a\tb\tc\td\n"broken\tb\tc\td\ne\tf\tg\th\n"q\nr"\tf\tg\th\nshort\tx\n'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = [(r.id, r.reason, r.cells[0] if r.cells else None) for r in parse_files(df, "text", NAMES, keep=["id"]).orderBy("id", "start").collect()]
    assert got[:5] == [(1, None, "a"), (1, "quoting", None), (1, None, "e"), (1, None, "q\nr"), (1, "columns", "short")]
    error = [o for o in Grammar(text, 4).records() if o.reason == "quoting"][0]
    assert text[error.start] == '"' and error.error_at is not None and text[error.end] == "e"


def test_a_broken_quote_swallows_no_known_start(spark):
    """Lines read as one text: each of them has the outcome that it has alone, also after a quote that runs on over its start."""
    rng = random.Random(3)
    pieces = ['"', '""', "\t", "\t", "\t", "a", "b c", "\n", "\r\n", "é"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    together = list(Grammar("\n".join(lines), 4, starts=starts).records())
    assert len(together) == len(lines)
    for line, start, one in zip(lines, starts, together, strict=True):
        alone = next(Grammar(line, 4, starts=[0]).records())
        assert one.start == start and (one.cells, one.reason) == (alone.cells, alone.reason)
        assert one.error_at is None and alone.error_at is None or one.error_at - start == alone.error_at
    whole = re.compile(r'(?:"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)(?:\t(?:"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?))*')
    assert all((one.reason == "quoting") == (whole.fullmatch(line) is None) for line, one in zip(lines, together, strict=True))


def test_whole_files_resume_where_a_record_can_be_read(spark):
    """Planted quotes that never close swallow the lines up to where the next quote shows the error; reading goes on at the next good line."""
    good = ["band{0}\ttitle\tgenre\tnote", 'band{0}\t"a\tb"\tgenre\t"says ""x"""']
    lines = [good[i % 2].format(i) for i in range(50)]
    for i in (7, 20, 21, 49):
        lines[i] = f'"broken{i}\ttitle\tgenre\tnote'
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)] + [("g", 1, None)], "file string, n int, raw string")
    texts = files_of_lines(df, "file", "n", "raw", lines=30)
    rows = parse_files(texts, "text", NAMES, keep=["file", "first_line"]).collect()
    loaded_bands = {r.cells[0] for r in rows if r.reason is None}
    assert {f"band{i}" for i in range(50)} - loaded_bands == {f"band{i}" for i in (7, 20, 21, 49)}
    assert [r.reason for r in rows if r.file == "g"] == ["columns"] and {r.first_line for r in rows if r.file == "f"} == {0, 30}
    assert sum(r.reason == "quoting" for r in rows) == 3  # the second of two broken lines that follow each other belongs to the first's error
