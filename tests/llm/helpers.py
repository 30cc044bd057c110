"""Comparison of a query with its DuckDB twin."""

import os

import duckdb

TABLES = ("documents", "pages", "labels", "benchmark", "embeddings")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like columns that operators use inside.
CLASH = ("id", "t", "w", "row", "digest", "fp", "split", "rank", "kept", "copies", "k", "epoch", "source_", "quality",
         "salt", "norm", "end", "root", "word", "run", "n", "a", "b")
LONG = "lorem ipsum dolor sit amet " * 20_000


def edge_rows():
    prose = " ".join(f"word{i} and{i * 7} more{i * 3}" for i in range(40))
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", None, None, 7),
        (None, prose, "fr", "b", None), (4, prose, "fr", "b", 9), (4, prose, "fr", "b", 9), (5, prose, None, "b", 9),
        (6, prose.replace(" ", "\n\n"), "de", None, 3), (7, prose + " tail", "en", "b", 3), (8, LONG, "en", "c", 1),
        (4, "other text under a repeated id " * 30, "en", "a", 2), (None, None, None, None, None),
        (9, "é\U0001f600 x" * 60, "es", "a", 5), (10, "a", "en", "a", 1), (11, "A", "en", "a", 1),
    ]


def edge_vectors():
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    return [(0, v), (0, v), (0, [3.0, 2.0, 1.0]), (50, v), (100, [2.0, 4.0, 6.0]), (150, None), (200, []), (250, [0.0, -0.0, 0.0]),
            (300, [1.0, None, 2.0]), (350, [1.0, nan, 2.0]), (400, [inf, 1.0, 1.0]), (None, v), (None, [-1.0, -2.0, -3.0]),
            (450, [1.0, 2.0]), (500, [5.0]), (7, [2.0, 1.0]), (8, [1e-30, 2e-30, 2e-30]), (9, [3e30, 1e30, 0.0]), (-50, [-1.0, 0.0, 0.0]),
            *[(i, v) for i in range(10, 30)], *[(i, [0.0, 1.0, float(i)]) for i in range(60, 140)]]


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(p):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def same_rows(df, con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(repr, res.fetchall()))
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), bad[:3])


def write_tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
