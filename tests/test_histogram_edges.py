"""A27_histogram on vectors at the edges of buckets and without components, against its SQL."""

from conftest import compare

from quarrymill.plans.registry import ORACLES, QUERIES


def test_edges_and_missing_components(spark, tmp_path):
    import duckdb

    rows = [(1, [0.0078124995, 1.0]), (2, [-1e-10]), (3, None), (4, []), (5, [None]), (6, [2.0]), (7, [-3.0]), (8, [0.25])]
    con = duckdb.connect()
    for kind in ("float", "double"):
        path = f"{tmp_path}/{kind}"
        spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").write.parquet(f"{path}/embeddings.parquet")
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
        compare(QUERIES["A27_histogram"](spark, path), con, ORACLES["A27_histogram"])
