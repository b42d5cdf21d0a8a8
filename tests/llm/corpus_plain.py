import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a query with its SQL twin over the tables of a folder."""

    def compare(sf_dir, frame, sql):
        db = duckdb.connect()
        for name in TABLES:
            db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
        columns = ", ".join(frame.columns)
        expected = db.execute(f"select {columns} from ({sql})").fetchall()
        assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, expected))

    return compare


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents with columns of names that operators use themselves."""

    def make(texts, ids=None, extra="text as t, 1 as score, 2 as a, 3 as h, 4 as rid, 5 as shard, 6 as fp, 7 as best, 8 as part"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        return rows.selectExpr("doc_id", "text", *extra.split(", ")) if extra else rows

    return make
