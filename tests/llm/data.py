"""Small documents with every awkward case, under columns whose names the operators use inside."""

import random

WORDS = "the of and river stone quiet lamp orbit paper violet anchor meadow copper thread signal harbor".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, key string, h string, gram string, "
    "line string, th string, run string, n string, doc string, print string, score string, ids string, class string"
)


def prose(rng, words):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(words))


def awkward_rows():
    rng = random.Random(7)
    passage = prose(rng, 70)
    near = passage.split()
    near[30] = "changed"
    base = [prose(rng, 40 + 5 * i) for i in range(12)]
    texts = [
        None,
        "",
        " \t\n\r\x0b\x0c ",
        "one",
        "1234 !!! 567",
        "ÀÉß ñandú 東京 \U0001f600 emoji space wide",
        "'s 't don't we'll  two  spaces\n\n\ttab " + "x" * 150,
        passage,
        base[0] + "\n" + passage + "\n" + base[1],
        base[2] + "\n" + " ".join(near) + "\nshort line",
        base[3],
        base[3],
        base[3].upper(),
        ("\n".join(base[4:8])),
        ("\n".join(base[4:8])) + " tail",
        prose(rng, 30_000),
        "same words " * 400,
        base[8] + "\n" + base[8],
        "\n".join(base[9:12]),
        base[9] + "\x00\x1c\x85" + base[10],
        "a" * 99,
        "b" * 100,
        "b" * 100,
        "c" * 250,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[1], (None, passage, None, None, None), (None, None, None, None, None)]
    return [r + ("x",) * 13 for r in rows]


def frame(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
