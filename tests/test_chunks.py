"""Content cut at any byte: pieces, counts and classification are those of the whole file."""

import random

from pyspark.sql import functions as F

from snapweave.operators import chunks as C
from snapweave.operators.classify import file_facts
from snapweave.plans.snapshot import Snapshot
from snapweave.session import cut_lineage

PARTS = [b"\r", b"\n", b"\r\n", b"a", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xf0", b"\x9f", b"\x98", b"\xe2\x82", b"\xed\xa0\x80",
         b"\xc0", b"\xf4\x90", b"\x80\x80\x80\x80", b"\xff", b"\xf0\x9f\x98", b"\xe0\x80", b"text of a line\n"]


def cut(rng, repo, path, data, longest):
    rows, at = [], 0
    while at < len(data) or not rows:
        n = rng.randint(1, longest)
        rows.append((repo, path, at, bytearray(data[at:at + n]), len(data)))
        at += n
    return rows


def sample(seed, names, longest, size):
    rng = random.Random(seed)
    files = {(f"r{i % 3}", f"d{i % 4}/{i}{rng.choice(names)}"): b"".join(rng.choice(PARTS) for _ in range(rng.randint(0, size)))
             for i in range(150)}
    rows = [r for (repo, path), data in files.items() for r in cut(rng, repo, path, data, longest)]
    return files, rows


def tables(spark, files, rows):
    whole = spark.createDataFrame([(r, p, bytearray(d), len(d)) for (r, p), d in files.items()],
                                  "repo string, path string, content binary, size long")
    return whole, spark.createDataFrame(rows, "repo string, path string, start long, content binary, size long").repartition(5)


def test_pieces_are_the_text(spark):
    for seed, longest in ((1, 1), (2, 3), (3, 8), (4, 40)):
        files, rows = sample(seed, [".txt"], longest, 60)
        _, chunks = tables(spark, files, rows)
        placed = cut_lineage(C.placed(cut_lineage(C.summaries(chunks))))
        got = {}
        for r in sorted(C.pieces(chunks, placed).collect(), key=lambda r: r.start):
            assert r.n_chars == len(r.text), (r, seed)
            got[(r.repo, r.path)] = got.get((r.repo, r.path), "") + r.text
        for key, data in files.items():
            want = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            assert got[key] == want, (key, data)


def test_facts_are_those_of_whole_files(spark):
    files, rows = sample(7, [".txt", "", ".zzz", ".png", ".py"], 700, 900)
    rng = random.Random(8)
    for i in range(40):  # around the sniff's end
        data = b"a" * rng.randint(4085, 4099) + rng.choice([b"\xe2\x82\xac", b"\0", b"\xff", b"b"]) + b"c" * rng.randint(0, 30)
        files[("s", f"{i}.zzz")] = data
        rows += cut(rng, "s", f"{i}.zzz", data, rng.choice([1, 50, 9000]))
    files[("s", ".gitignore")] = b"*.log\r\n!a.log\n"
    rows += cut(rng, "s", ".gitignore", files[("s", ".gitignore")], 3)
    whole, chunks = tables(spark, files, rows)
    placed = cut_lineage(C.placed(cut_lineage(C.summaries(chunks))))
    want = {(r.repo, r.path): r.asDict() for r in file_facts(whole).collect()}
    got = {(r.repo, r.path): r.asDict() for r in C.chunked_facts(placed).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == want[key], key


def test_the_place_is_the_key(spark):
    """A third of all chunks are one file's; no step groups them but partial sums."""
    rows = [("r", "hot.txt", i * 2, bytearray(b"ab"), 4000) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "repo string, path string, start long, content binary, size long")
    placed = C.placed(cut_lineage(C.summaries(chunks)))
    assert placed.agg(F.sum("chars")).first()[0] == 4000
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_snapshot_of_chunks_is_the_snapshot_of_files(spark, tmp_path):
    from snapweave.sinks import write_snapshot
    rng = random.Random(9)
    files = {("r", "big.txt"): b"".join(b"line %d \xe2\x82\xac of the file\r\n" % i for i in range(3000)), ("r", "empty.py"): b"",
             ("r", "b.zzz"): b"\0" * 100, ("r", "no_end.txt"): b"x\ny", ("q", ".gitignore"): b"*.log\n", ("q", "a.log"): b"1\n"}
    rows = []
    for (repo, path), data in files.items():  # cut after line ends, as the tree source does
        at = 0
        while at < len(data) or not at:
            end = data.find(b"\n", at + rng.randint(1, 20_000)) + 1 or len(data)
            rows.append((repo, path, at, bytearray(data[at:end]), len(data)))
            at = max(end, 1)
    whole, chunks = tables(spark, files, rows)
    a, b = Snapshot(whole), Snapshot(chunks)
    assert a.stats.orderBy("repo").collect() == b.stats.orderBy("repo").collect()
    texts = []
    for snap, name in ((a, "a"), (b, "b")):
        write_snapshot(snap.sections(), f"{tmp_path}/{name}")
        texts.append([("".join(x.value for x in sorted(part, key=lambda x: x.file))) for repo in "qr" for part in [
            spark.read.text(f"{tmp_path}/{name}/repo={repo}", wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).collect()]])
    assert texts[0] == texts[1] and "line 2999" in texts[0][1]
