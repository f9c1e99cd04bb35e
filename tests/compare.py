"""Hold registered queries against their SQL on one set of tables: python tests/compare.py [dir] [name...]"""

import numbers
import sys
import time

import pandas

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def compare(spark, sf_dir, name, query, sql):
    """None if both sides have the same rows, else what differs."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    cols = sorted(want.columns)
    if cols != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {cols}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"

    def text(df):
        def one(v):
            if v is None or v is pandas.NA or v is pandas.NaT or v != v:
                return "-"
            return f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

        return sorted("|".join(one(v) for v in r) for r in df[cols].itertuples(index=False, name=None))

    a, b = text(got), text(want)
    return None if a == b else next(f"{x[:300]} / {y[:300]}" for x, y in zip(a, b) if x != y)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    sql = e.oracle_sql()
    for n, q in e.queries().items():
        if names and not any(n.startswith(x) for x in names) or not names and (n.startswith("op") or n == "pipeline"):
            continue
        t = time.time()
        try:
            r = compare(spark, sf, n, q, sql[n]) if n in sql else f"(no SQL) {q(spark, sf).count()} rows"
        except Exception as x:
            r = f"ERROR {str(x)[:500]}"
        print(n, "ok" if r is None else r, f"{time.time() - t:.1f}s", flush=True)
