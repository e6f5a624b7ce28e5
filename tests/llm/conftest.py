import random

import pytest

#: Names that the operators use themselves.
TAKEN = "body key node dc_items dc_item dc_body dc_coverage items item coverage changed q_body q_score score row f_slot f_page f_bits nj_key ld_body ld_id ld_gone ld_late ld_text ld_exact ld_near id exact near late gone n token label l_id digest slot".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in TAKEN)


def frame(spark, rows):
    """A documents table with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"own {name}" for name in TAKEN]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, characters beyond the common ones."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = sentence(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None), (1, ""), (2, "  \n \n"), (3, "one two"), (4, "One  two"), (5, base), (6, " ".join(near)), (7, base), (7, base), (8, base.upper()),
        (9, "A line that is repeated somewhere.\nA line that is repeated somewhere!\nother"), (10, "other\nA line that is repeated somewhere."),
        (11, "token=token: abcdefghijk passwd = 'zzzzzzzz9' AKIAAKIAAAAABBBBB 0123456789abcdef0123456789abcdef\U0001f600"), (12, "\U0001f600 Ünï̈cödé 　\x1c\x85 \t\r\n tab"),
        (13, sentence(30_000)), (14, "x" * 50_000), (15, "stupid " * 30), (16, "Ha Ha Ha Ha " * 40), (None, "a row without an id, with words enough to count"), (None, base),
    ]
    rows += [(100 + i, sentence(rng.randint(1, 80)) + "\n" + sentence(12)) for i in range(60)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture
def nothing(spark):
    return frame(spark, [])
