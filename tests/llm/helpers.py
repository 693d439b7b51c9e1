"""Small inputs shared by the tests: odd rows, and columns whose names clash with the operators' own."""

import random

CLASH = "id long, score double, kept boolean, class string, n int, chunk int, word string, bucket int, h long, rank long, doc int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
FILL = (9, 0.5, True, "c", 1, 2, "w", 3, 4, 5, 6)


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) as a documents table with clashing columns."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, len(r[1]) if r[1] else None, *FILL) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    syllables = ["ka", "to", "mi", "re", "lu", "so", "na", "vi"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long = prose(rng, 6000)
    return [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (None, "text without an id"), (5, long), (6, long),
            (7, "one two three four five six seven"), (7, "one two three four five six seven"), (8, "a b"), (9, "A B"), (10, "é ü 中 😀"), (11, "\n\n x\n")]
