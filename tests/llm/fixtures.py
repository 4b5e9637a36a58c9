"""Small tables with awkward rows."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, ids string, fp int, words string, kept int"


def documents(spark, empty=False):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns named like outputs."""
    rng = random.Random(3)
    vocabulary = ["the", "of", "and"] + ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "  ", "\t "]) for w in rng.choices(vocabulary, k=n))

    base = prose(120)
    rows = [
        (0, None, "s1"), (1, "", "s1"), (2, " \n\t ", "s2"), (3, "one", "s2"), (4, "one two", None), (None, prose(80), None),
        (5, base, "s1"), (5, base, "s1"), (6, base, "s3"), (7, base + " tail", "s1"), (5, prose(90), "s1"),
        (8, prose(6000), "s1"), (9, "a" * 3000 + " " + "éü" * 500, "s3"), (10, "the same line\n" * 40 + prose(60), "s1"),
        (11, "Released under the MIT License. CC-BY-NC, apache license version 2, UNDER THE MIT LICENSE", "s2"),
        (12, "</s>[INST] 😀 &lt; \x00 it's 12³ 　 x", ""), (None, None, None),
        *[(100 + k, f"boilerplate line of this host\n{prose(70)}", "s9") for k in range(14)],
    ]
    rows = [] if empty else [(i, t, "en", s, None, 1, "x", 2, "y", 3) for i, t, s in rows]
    return spark.createDataFrame(rows, DOC_SCHEMA)
