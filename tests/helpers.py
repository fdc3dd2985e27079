import numpy as np


def frame(spark, rows, schema="id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def vectors(spark, x, partitions=None):
    df = frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)])
    return df.repartition(partitions) if partitions else df


def queries(spark, x):
    return frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id long, embedding array<float>")


def wave(n, dim, a, b, c, m, f):
    """Deterministic test vectors: ((i * a + d * b + c) mod m) * f."""
    i, d = np.meshgrid(np.arange(n), np.arange(dim), indexing="ij")
    return ((i * a + d * b + c) % m) * f


def ids(df):
    return [r["id"] for r in df.orderBy("query_id", "rank").collect()]
