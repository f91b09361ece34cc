import random

import pytest

WORDS = "la le que mento der und ge ich the of and ing tion er el los con para".split()


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + 12]) for i in range(0, n, 12))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, white and long texts, ties, repeated rows, and columns with clashing names."""
    shared = prose(900, 30)
    rows = [
        (1, prose(1), "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t ", "de", "b", 5),
        (5, prose(1), "en", "a", 10), (5, prose(1), "en", "a", 10), (5, prose(5), "fr", "a", 9), (None, prose(1), None, "a", 10),
        (None, prose(7), "de", "b", 1), (8, prose(8) + "\n" + shared, "es", "b", 3), (9, prose(9) + "\n" + shared + "\nSHARED LINE of some length", "es", "b", 3),
        (10, "shared line of some length  \n" + shared, "es", None, 3), (11, "\x00" + prose(11) + "\x00é漢字😀", "en", "c", 2), (12, "one", "en", "c", 2),
        (13, prose(13, 4000), "en", "c", 2), (14, "word " * 60, "en", "c", 2), (15, "12345 --- 6789", "en", "c", 2), (-3, prose(8), "es", "c", 2),
    ]
    rows = [(*r, 1, 2, 3, 4, "x", "y", "z", 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, tkey int, part int, label int, open string, pick string, lang_pred string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
