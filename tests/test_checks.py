"""Every registered query runs and, where SQL can say it, equals its SQL twin."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import checks
from checks import files
from tracelake.session import work_dir

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def key(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(row) for row in frame.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    assert name in ORACLES
    cursor = db.execute(ORACLES[name])
    names = [item[0] for item in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert columns == [names[i] for i in order]
    assert got == sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["csv_roundtrip", "text_roundtrip", "csv_short_lines", "csv_rejects"])
def test_file_queries_write_many_files(spark, monkeypatch, name):
    """A table of many partitions goes to many files, and the result is that of one."""
    read, folders = files.table, []

    def made(*args):
        folders.append(work_dir(*args))
        return folders[-1]

    monkeypatch.setattr(files, "table", lambda *args: read(*args).repartition(4, F.rand(3)))
    monkeypatch.setattr(files, "work_dir", made)
    got = sorted(map(str, QUERIES[name](spark, SF).collect()))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folders[0])
    assert written.select("path").distinct().count() >= 4 * (2 if "roundtrip" in name else 1)
    monkeypatch.setattr(files, "table", lambda *args: read(*args).coalesce(1))
    assert got == sorted(map(str, QUERIES[name](spark, SF).collect())) and got
