"""Small manifests for tests."""


def make_manifest(spark, rows, repo="r"):
    """rows: (path, content bytes or None) or (repo, path, content)."""
    norm = []
    for r in rows:
        if len(r) == 2:
            norm.append((repo, r[0], None if r[1] is None else bytearray(r[1])))
        else:
            norm.append((r[0], r[1], None if r[2] is None else bytearray(r[2])))
    df = spark.createDataFrame(norm, "repo string, path string, content binary")
    from pyspark.sql import functions as F
    return df.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint"))
