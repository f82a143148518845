import pytest

WORDS = "the of a river stone green walks under bright morning with quiet hands and slow water over old bridge near market where people sell bread to each other every day".split()


def prose(seed: int, n: int) -> str:
    """n words in sentences, different for each seed."""
    x, out = seed * 7919 + 13, []
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 16) % 3 else str((x >> 4) % 97))
        out.append(w + ("." if k % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = "\n".join(prose(k, 40) for k in range(500))
    rows = [
        (1, prose(1, 120), "en", "a", 5), (2, prose(1, 120), "en", None, 5), (3, None, None, None, None), (4, "", "fr", "b", 0), (5, " \n\t", "fr", "b", 3),
        (None, prose(2, 80), "en", "a", 1), (None, None, None, None, None), (6, "one two", "de", "\U0001f642", 7), (6, "one two", "de", "\U0001f642", 7), (7, long, "en", "a", len(long)),
        (8, long + " more", "en", "c", 1), (9, "x" * 50_000, "en", "c", 1), (10, "日本 語の テキスト é\x00ü", "xx", "c", 1), (11, "# $ % *** 12 34", "en", "c", 2),
    ]
    extra = "n long, size long, prefix string, hash string, key string, component string, s string, w string, at long, chunk int, pattern string, `kept` boolean, `a` long, token string, target double, _row string"
    data = [(*r, k, k, "p", "h", "k", "c", "s", "w", k, k, "x", True, k, "t", 1.0, "r") for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
