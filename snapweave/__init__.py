"""snapweave: source-corpus snapshots as Spark DataFrame operators."""

from .api import (Options, ancestors, combine, disposition, is_ignored, is_text,  # noqa: F401
                  manifest_from_table, manifest_from_tree, manifest_rejects, parse_rules, path_parts,
                  prune, rules_found, scan,
                  snapshot, stats, tree, write_snapshot, write_stats)
