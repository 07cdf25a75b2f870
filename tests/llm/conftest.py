import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """Random prose with shared passages, copies, near copies, odd and null texts."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(["an", "the", "er", "tion", "re", "É", "st."], int(r.integers(1, 5))))
    shared = " ".join(word() for _ in range(60))
    out = []
    for i in range(120):
        t = " ".join(word() for _ in range(int(r.integers(0, 200))))
        if i % 6 == 0:
            t = t + "  \n" + shared[: int(r.integers(50, len(shared)))] + "\t" + word()
        if i % 10 == 3 and out:
            t = out[-1] or ""
        if i % 10 == 7 and out:
            t = (out[-1] or "") + " extra"
        out.append(t)
    return [*out, None, "", "   \t\n", "a", "A b", None, "x " * 30_000, "1" * 50_000]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b", "hot", "hot"][i % 5], 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "a", 0), (-7, texts[0], None, "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.selectExpr("*", "'x' as chunk", "1 as fp", "2 as size", "'y' as label", "3 as cell", "0 as place", "1 as learn")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
