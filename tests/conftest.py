import pytest

from veilcraft.functions.cipher import CipherKey, TokenCipher
from veilcraft.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("veilcraft-tests", cores=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cipher(spark):
    return TokenCipher(spark, CipherKey(bytes(range(64))))


@pytest.fixture
def evaluate(spark):
    """Evaluate ``build(column)`` for a list of texts, keeping their order."""

    def run(build, texts, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}")
        rows = df.select("i", build(F.col("t")).alias("r")).collect()
        return [row["r"] for row in sorted(rows, key=lambda row: row["i"])]

    return run
