"""A mirror of a remote tree: a walk first, then increments from the token that was taken before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.feed import applied
from trellis.operators.nodes import pruned
from trellis.operators.state import backfilled, to_walk
from trellis.sources.store import Store
from trellis.sources.tables import staged

TOKEN, WALKED = "page_token", "walk_done"
#: The changes after a token, and the token after them.
Feed = Callable[[str], tuple[DataFrame, str]]
Walk = Callable[[], DataFrame]


def rebuild(store: Store, token: Callable[[], str], walk: Walk) -> int:
    """The mirror anew. The token comes first, so that changes made during the walk are met again by the next increment."""
    now = token()
    return store.commit({"nodes": walk()}, {TOKEN: now, WALKED: "1"})


def refresh(store: Store, token: Callable[[], str], walk: Walk, feed: Feed, subtrees: Callable[[DataFrame], DataFrame] | None, root_id: str, seq: str = "seq") -> int:
    """Walks where that was never done, then merges the changes since the token, reads unknown folders, and prunes.

    Rows and token are one commit: after a crash the same changes come again, and merging them twice changes nothing.
    """
    if store.meta(WALKED) is None:
        rebuild(store, token, walk)
    nodes = store.table("nodes")
    changes, after = feed(store.meta(TOKEN) or "")
    changes = staged(changes, "changes")
    if subtrees is None:
        merged = applied(nodes, changes, "file_id", seq, F.col("removed"))
    else:
        merged = backfilled(nodes, changes, subtrees(to_walk(changes, nodes, root_id)), seq)
    merged = staged(merged, "merged")
    return store.commit({"nodes": merged.join(pruned(merged, root_id).select("file_id"), "file_id", "left_anti").select(*nodes.columns)}, {TOKEN: after})
