"""Every query beside its SQL, at the smallest scale."""

import duckdb
import pytest
from conftest import SF

from wordloom.queries import catalogue

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = _rows(df.select(*[f"`{c}`" for c in cols]).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = duck.sql(sql)
    types = dict(zip(out.columns, map(str, out.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [out.columns.index(c) for c in cols]
    assert got == _rows([tuple(r[i] for i in at) for r in out.fetchall()])


def test_second_vendor_of_wide_letters_and_shared_terms(spark, tmp_path):
    """ß in upper case is one letter; two words of one Arabic form are two pairs."""
    words = {"the": 20, "and": 19, "erstß": 18, "aaa": 17, "ااا": 16, "ﬁve": 15}
    spark.createDataFrame([("en", " ".join(w for w, n in words.items() for _ in range(n)))], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = con.sql(catalogue.oracle_sql()["second_vendor_agreement"])
    got = catalogue.queries()["second_vendor_agreement"](spark, str(tmp_path)).select(*out.columns).collect()
    assert _rows(got) == _rows(out.fetchall()) and len(got) == 5


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "term", "freq", "ngram_size"]
    assert df.count() > 50
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())
