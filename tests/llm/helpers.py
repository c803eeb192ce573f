"""A table of awkward documents: null ids, texts and sources, repeated rows, long and
empty texts, and extra columns with names that operators use themselves."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, `row` string, score double, fp string, base string"
EXTRA = (1, "k", "r", 0.5, "f", "b")

LONG = "word " * 40_000 + "end."
VARIED = " ".join(f"w{i * 7919 % 10007:x}é{'.' if i % 13 == 0 else ''}{chr(10) if i % 41 == 0 else ''}" for i in range(25_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "A plain text of some words, with nothing in it to find.",
    "A  plain text of\nsome words, with nothing in it to find.",
    "Mail ann.lee@mail.example.com or ring +1 (415) 555-2671 now. 10.20.30.40 and 300.1.2.3 as well as 4539 1488 0343 6467.",
    "Mail ann.lee@mail.example.com or ring +1 (415) 555-2671 now. 10.20.30.40 and 300.1.2.3 as well as 4539 1488 0343 6467.",
    "Released under the MIT License.\nDer Text geht weiter und ist nicht lang.",
    "Überall grüßen Äpfel 日本語 текст ελληνικά \U0001f600 \x00 end",
    LONG,
    VARIED,
]


def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t), *EXTRA) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id", None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
