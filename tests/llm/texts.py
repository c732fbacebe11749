"""Made documents for the tests."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents():
    """(doc_id, text): copies, near copies, shared passages, odd bytes, blanks, nulls, long texts."""
    base, shared = prose(1, 120), prose(2, 60)
    rows = [(0, base), (1, base), (2, base.replace("alpha", "Alpha", 1) + " tail"), (3, shared + "\n" + prose(3, 40)),
            (4, prose(4, 30) + " " + shared), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, "One two"),
            (11, "é" * 200), (12, "x" + "é" * 200), (13, "ab " * 300), (14, "same line here\n" * 12 + prose(5, 30)),
            (15, prose(6, 4000)), (16, prose(6, 4000)[:9000] + shared), (17, "## $$ | <b> " + prose(7, 25)),
            (18, "Released under the MIT License\n" + prose(8, 20)),
            (19, "see\nLicensed under CC\nBY-NC 4.0.\n\n" + prose(9, 12) + " gnu general\npublic license"),
            (20, prose(10, 9) + "   " + shared.upper()), (21, "ünïcödé 漢字 " * 20)]
    return rows
