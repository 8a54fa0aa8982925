import random

import pytest

SF = "/root/testdata/sf0.001"
CLASHES = "key long, digest long, off int, size long, kept boolean, root long, uid long, h long, tasks string, items string"


@pytest.fixture(scope="session")
def docs(spark):
    """All documents of the smallest table."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, copies, runs, separators."""
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(300)]
    prose = " ".join(rng.choices(vocab, k=400))
    other = " ".join(rng.choices(vocab, k=3000))
    near = prose.split()
    near[200] = "changed"
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "One"), (5, "a b c"), (6, prose), (7, prose),
            (8, " ".join(near)), (9, other), (10, "Intro line\n" + prose[:900] + "\nthe end of it"),
            (11, "x" * 1500), (12, "x" * 700 + "y"), (13, "ab " * 500), (14, "l1 a\nl1 a\nl1 a\n\n\n" * 30),
            (15, other + " " + prose), (16, "é ü 漢字 " * 60), (17, "\x1c\x1d a\x85b c"), (18, prose.upper()),
            (19, "".join(rng.choices("abc \n", k=5000))), (20, "z"), (21, "q r s t u"), (22, "q r s t u"),
            (23, " ".join(rng.choices(vocab, k=20_000)))]
    # Thue-Morse strings and their complements: every polynomial modulo 2**64
    # takes the two for one.
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    spread, mirror = (" ".join(x[:1024]) for x in (morse, other))
    rows += [(24, morse), (25, other), (26, f"{prose[:700]} {morse} {prose[-700:]}"), (27, f"{prose[:700]} {other} {prose[-700:]}"),
             (28, f"{morse}\n{other}\n{morse}"), (29, spread), (30, mirror), (31, f"{prose[:50]} {spread} {prose[:50]}"),
             (32, f"{prose[:50]} {mirror} {prose[:50]}")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with null and hot sources and clashing extra columns."""
    rows = [(d, t, None if d % 5 == 0 else "en", None if d % 7 == 3 else "hot" if d % 2 else "s%d" % (d % 4), 1,
             *[None] * 10) for d, t in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
