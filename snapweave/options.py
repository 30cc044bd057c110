"""Behaviour switches. Defaults reproduce the original tool; each switch names the trap of
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # T-1: folder patterns ("name/") match only below the folder by default, so the folder itself is
    # shown and only its subfolders are pruned. True tests folders as "path/", as git does, so the
    # folder itself is pruned.
    prune_folders: bool = False
    # T-4: a multi-byte character cut by the 4096-byte sniff window makes a file binary. False
    # backs off up to three bytes at the cut before deciding.
    strict_boundary: bool = True
    # T-7: names starting with "__" (and everything below them) are hidden from the tree.
    hide_dunder: bool = True
    # T-5: extra or replacing entries for the built-in MIME table, as (".ext", "type/subtype").
    mime_overrides: tuple[tuple[str, str], ...] = ()
    # T-14: a repository may not list the same path twice when its contents are assembled.
    require_unique_paths: bool = True
    # Keep tree depths 0..max_depth (None: all).
    max_depth: int | None = None
    # Largest text, in bytes, of all repositories' rule plans that is sent to every executor; beyond
    # it they are joined by a shuffle whose hot partitions AQE splits.
    broadcast_bytes: int = 8 << 20


DEFAULT = Options()
