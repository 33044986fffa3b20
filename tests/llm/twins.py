"""Compares a training-data query with its SQL twin."""

import duckdb

from runtally.llm.catalog import QUERIES
from runtally.llm.oracles import ORACLES


def assert_twin(spark, name, sf_dir, tables=("documents", "embeddings", "conversations")):
    connection = duckdb.connect()
    for t in tables:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours = QUERIES[name](spark, sf_dir)
    columns = ", ".join(ours.columns)
    theirs = connection.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(theirs, key=repr)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    described = connection.execute(f"DESCRIBE SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    assert [kinds[k] for _, k in ours.dtypes] == [row[1] for row in described]
