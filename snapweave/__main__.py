"""``python -m snapweave ROOT [ROOT ...] --out DIR``: snapshot folders into documents.

Each root is one repository (named after the folder). Documents land in
``DIR/documents/repo=<name>/`` (part files in name order form the document) and statistics in
``DIR/stats``; the statistics are also printed, one JSON line per repository.
"""

from __future__ import annotations

import argparse
import json

from .options import Options
from .plans.snapshot import Snapshot, now_timestamp
from .session import drop_materialized, local_session
from .sinks import write_snapshot, write_stats
from .sources.tree_source import manifest_from_tree


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="snapweave", description=__doc__.splitlines()[0])
    ap.add_argument("roots", nargs="+", help="project folders, one repository each")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--max-depth", type=int, default=None, help="tree depth limit")
    ap.add_argument("--prune-folders", action="store_true",
                    help="folder patterns also match the folder itself (as git does)")
    ap.add_argument("--master", default="local[*]", help="Spark master for a local run")
    args = ap.parse_args(argv)

    spark = local_session(args.master.removeprefix("local[").removesuffix("]")
                          if args.master.startswith("local[") else "*")
    opts = Options(max_depth=args.max_depth, prune_folders=args.prune_folders)
    manifest = manifest_from_tree(spark, args.roots, prune_folders=args.prune_folders)
    snap = Snapshot(manifest, now_timestamp(), options=opts)
    write_snapshot(snap.sections(), f"{args.out}/documents")
    write_stats(snap.stats, f"{args.out}/stats", f"{args.out}/documents")
    drop_materialized(spark)
    for row in spark.read.parquet(f"{args.out}/stats").orderBy("repo").toLocalIterator():
        print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
