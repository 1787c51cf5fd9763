from pathlib import Path

import __spark_entry__ as entry
from iolens.runtime import drop_written, shared_dir, written

from .conftest import rows


def test_written_tables_lie_in_the_shared_folder_until_dropped(spark):
    drop_written(spark)
    df = written(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), "runtime_test")
    root = Path(shared_dir(spark).removeprefix("file:"))
    assert rows(df) == [(1, None), (2, "b")] and any(root.glob("iolens-runtime_test-*"))
    empty = written(df.where("false"), "runtime_test")
    assert empty.count() == 0 and empty.schema == df.schema
    drop_written(spark)
    assert not any(root.glob("iolens-runtime_test-*"))


def test_queries_and_sql_go_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(f"p{n}_found" in queries for n in (1, 2, 3, 4))
