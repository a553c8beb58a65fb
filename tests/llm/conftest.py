import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: A column of every name that the operators make themselves.
CLASHING = ("kept", "keep_id", "component_id", "digest", "norm", "salt", "row", "key", "node", "n", "spans", "score", "pos", "gram", "votes", "ids", "__id", "__digest", "dropped_id", "dropped_key", "text_key", "runs", "sample")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        df = spark.createDataFrame([(i, t) for i, t in rows], DOCS)
        if clashing:
            df = df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHING))
        return df

    return make


@pytest.fixture(scope="session")
def sql():
    def run(tables, query):
        con = duckdb.connect()
        for name, path in tables.items():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        cursor = con.execute(query)
        names = [d[0] for d in cursor.description]
        return sorted(tuple(zip(*sorted(zip(names, map(str, row))))) for row in cursor.fetchall())

    return run


def canonical(df):
    """Rows with their columns by name, as text."""
    return sorted(tuple(zip(*sorted(zip(df.columns, map(str, row))))) for row in df.collect())
