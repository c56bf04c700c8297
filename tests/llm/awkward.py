"""Awkward documents."""

import random

WORDS = "the of and was river stone light morning under field long road house water bread song winter glass north bell".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    long_text = prose(rng, 4000)
    base = [prose(rng, 120) for _ in range(8)]
    shared = prose(rng, 70)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    near = base[0].split()
    near[60] = "changed"
    rows += [
        (10, base[0], "en", "src0", len(base[0])),
        (11, " ".join(near), "en", "src0", 1),
        (12, base[1] + " " + shared, "de", "src1", 1),
        (13, shared + " " + base[2], None, "src1", 1),
        (13, shared + " " + base[2], None, "src1", 1),
        (14, None, "en", "src2", None),
        (15, "", "en", None, 0),
        (16, " \t\n ", "en", None, 4),
        (None, base[3], "en", "src2", 1),
        (None, None, None, None, None),
        (17, long_text, "fr", "src0", len(long_text)),
        (18, "one two", "fr", "src0", 7),
        (19, "été — 日本語   \x1c ok ½ ﬁ İ ǅ é <|endoftext|> it's 42", "fr", "src0", 7),
        (20, base[4], "en", "src2", 1),
        (20, base[5] + " tail", "en", "src2", 1),
    ]
    return rows
