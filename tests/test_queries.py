import importlib.util

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 30


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    from pathlib import Path

    import duckdb

    from tests.verify import rows_of

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(SMALL).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, SMALL)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), names)


def test_nothing_else_imports_the_text_subpackage():
    from pathlib import Path

    root = Path(importlib.util.find_spec("skeinfeed").origin).parent
    files = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert files and not [p for p in files if "skeinfeed.llm" in p.read_text()]
