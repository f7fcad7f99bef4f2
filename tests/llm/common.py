"""Rows with everything that operators must bear, and plain versions of what they compute."""

import itertools

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()
LONG = " ".join(f"{a}{b}" for a, b in itertools.product(WORDS, range(1500)))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, record string, row string, size bigint, start bigint, score double, bin int, tie bigint, copies int, cls bigint, tkey bigint, bucket int, place int, x string"
TEXTS = [(0, "alpha bravo charlie"), (1, None), (2, ""), (3, " \n\t "), (None, "no id here, none at all"), (4, "the same text twice " * 20), (4, "the same text twice " * 20), (5, LONG), (6, "one"), (7, "One"), (8, "tabs\tand\r\nother  blanks   here too"), (9, "été naïve 中文 \U0001f600 <|endoftext|> end"), (10, "the same text twice " * 20), (None, None)]


def awkward(spark, rows=TEXTS):
    """Nulls in any column, empty and long texts, repeated rows, and columns named as the operators' own."""
    full = [(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 3}", None, "r", None, 1, 2, None, 3, 4, 5, 6, 7, 8, 9, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_classes(rows, width, percent):
    """(doc_id, set size, least doc_id reachable) of rows with ids, comparing every two."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))
