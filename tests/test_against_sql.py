"""Registered queries against their SQL on tables made for their edges."""

import datetime as dt
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables, sorted."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_three_equal_distances(spark, tmp_path):
    """The effective number of three equal weights is 3 or one bit less; patient g has visits g weeks apart."""
    prices = [1e5, 3e5, 2e5, 4e5]
    rows = [(g, dt.date(1995, 1, 2) + dt.timedelta(weeks=g * i), x) for g in range(1, 23) for i, x in enumerate(prices)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_totalprice double")
    got, want = both(spark, tmp_path, "weighted_autocorr", orders=orders)
    assert [r[0] for r in got] == [r[0] for r in want] and 12 not in [r[0] for r in got]
    assert all(g[1] == pytest.approx(w[1], abs=2e-9) and math.isclose(g[2], 3) for g, w in zip(got, want, strict=True))


def test_report_counts_the_same_patients(spark, tmp_path):
    """Patients 11, 12 and 13 with three equal distances: SQL counts two of them."""
    rows = [(g, dt.date(1995, 1, 2) + dt.timedelta(weeks=g * i), x) for g in (11, 12, 13) for i, x in enumerate([1e5, 3e5, 2e5, 4e5])]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_totalprice double")
    got, want = both(spark, tmp_path, "autocorrelation_report", orders=orders)
    assert got[0][4:] == want[0][4:] and got[0][4] == 2
    assert got[0][:4] == pytest.approx(want[0][:4], abs=2e-9)


def test_report_of_nine_digits(spark, tmp_path):
    """Three correlations whose mean is -0.248617204 as they are and -0.248617205 of their nine digits, which SQL adds up."""
    rng = random.Random(10)
    rows = [(p, dt.date(1995, 1, 2) + dt.timedelta(weeks=i), float(rng.randrange(1000, 500000))) for p in range(3) for i in range(6)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_totalprice double")
    got, want = both(spark, tmp_path, "autocorrelation_report", orders=orders)
    assert got == want and got[0][0] == -0.248617205


def test_checks_of_nine_digits(spark, tmp_path):
    """Three first scores whose mean is just below 1.0000005, and above it by their nine digits."""
    rows = [(p, dt.date(1995, 1, 2), x * 500000 / 27) for p, x in enumerate([1.0000004996, 1.0000004996, 1.0000005006])]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_totalprice double")
    got, want = (dict(r[:2] for r in rows)["baseline_mean"] for rows in both(spark, tmp_path, "validation_checks", orders=orders))
    assert got == want == 1.000001


def test_means_on_an_edge(spark, tmp_path):
    """Values added up in order of time, whatever order the rows are in: by some orders a mean of 25 or 40 falls short of it."""
    import random

    rng, rows = random.Random(5), []
    for user in range(400):
        edge = rng.choice([1500, 2500, 4000, 5500, 7500])
        a, b, c = (rng.randint(100, edge) for _ in range(3))
        for i, cents in enumerate([a, b, c, 4 * edge - a - b - c]):
            rows.append((4 * user + i, dt.datetime(2024, 1, 1, i), user, cents / 100))
    schema = "event_id long, ts timestamp, user_id long, value double"
    db_rows = spark.createDataFrame(rows, schema).coalesce(1)
    got, want = both(spark, tmp_path / "sorted", "score_histogram", events=db_rows)
    assert got == want
    spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(5).write.parquet(f"{tmp_path}/dealt/events.parquet")
    assert sorted(tuple(r) for r in entry.queries()["score_histogram"](spark, f"{tmp_path}/dealt").collect()) == want


@pytest.mark.parametrize("name", ["score_histogram", "score_labels"])
def test_means_of_events_out_of_time(spark, tmp_path, name):
    """Values are added up in the order of the table, which is that of ids, where times run against it."""
    rng, rows = random.Random(6), []
    for user in range(600):
        edge, n = (rng.choice([1500, 4000, 7500]), 4) if user % 2 else (10000 / 3, 3)
        cents = [rng.randint(100, 3000) for _ in range(n - 1)]
        for i, x in enumerate([*cents, round(n * edge) - sum(cents)]):
            rows.append((n * 1000 * user + i, dt.datetime(2024, 1, 1, 20 - i), user, x / 100))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1)
    got, want = both(spark, tmp_path, name, events=events)
    assert got == want
