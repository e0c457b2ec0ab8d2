import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, h double"
#: Names of extra columns that clash with names the operators could use themselves.
CLASHES = "budget left whole stop keep _keep kept _kept many _many sha _sha n d _d l _l s _s gone _gone rid pos line line_no at node word bit mask domain _domain epoch _epoch tokens _tokens _budget _salt _rn _n rank _rank held_out score predicted text_sha256 component_id root digest ids piece offset".split()


def hostile_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd white space, clashing extra columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "straße", "ñandú", "omega!", "x|y", "***"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = prose(120)
    texts = [base, base, base.replace(" ", "\n", 3), base.replace("alpha", "Alpha"), base + " tail", None, "", "   ", "\t\n", "a", "7 8 9", prose(8000), "z" * 70_000, "one two three four five\none two three four six\none two three four five", "word " * 300, "a <|endoftext|> b  c\n  d'll \n", "x y   z", "İstanbul ΣΑΣ ﬁ é"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src0", "src1"][i % 3], None, 1, 0.5) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "src0", 5, 1, 0.5), (40, base, "en", "src0", 5, 1, 0.5), (41, None, None, None, None, None, None), (None, base, "en", "src0", 3, 1, 1.0), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hostile(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(hostile_rows(), SCHEMA)
    return rows.select("*", *[F.lit(i).alias(c) if i % 2 else F.lit(c).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
