"""Queries on small tables of odd rows give the rows of their SQL."""

import duckdb
import pytest

from spanloom.plans import registry


def same(spark, tmp_path, name, **tables):
    """The rows of a query over tables (each a DataFrame), after comparing them with its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)
    return got


def test_turns_without_a_word(spark, tmp_path):
    texts = [None, "", "a b c", "é!", "Alpha beta"]
    rows = [(c, t, "user", texts[(c + t) % 5]) for c in range(5) for t in range(12)]
    got = same(spark, tmp_path, "validate_batch", conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert len(got) == 60 and any("model_inference" in r for r in got)


@pytest.mark.parametrize("starts", [(0, 13_000, 140_000), (0, 3_080_000)])
def test_frames_over_years(spark, tmp_path, starts):
    """A stream takes all rows of a table that lasts longer than any fixed delay, in no order of time, and beyond 2262 too."""
    ids = [i for a in starts for i in range(a, a + 12)]
    rows = [(i, "", "web", "en" if i % 5 else "de", i % 7 * 400) for i in sorted(ids, key=lambda i: i * 7919 % 101)]
    got = same(spark, tmp_path, "frame_cadence", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert max(r[2] for r in got) >= starts[-1] and 4 * len(starts) <= len(got) < len(ids)
