"""Paths of a JSON tree, found in one walk inside the row that holds it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import PATH_SEPARATOR


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError(f"a key twice in one group of the tree: {sorted(k for k, _ in pairs)}")
    return found


def leaves_of(text: str) -> list[tuple[str, str]]:
    """(path, leaf) of ``{group: [leaf | {group: [..]}]}`` of any depth; a group that is an object has its keys as leaves."""
    out: list[tuple[str, str]] = []
    waiting = [("", json.loads(text, object_pairs_hook=_object))]
    while waiting:
        path, node = waiting.pop()
        if not isinstance(node, dict):
            raise ValueError(f"no object at the top of the tree: {type(node).__name__}")
        for name, group in node.items():
            start = f"{path}{name}{PATH_SEPARATOR}"
            if isinstance(group, dict):
                out.extend((start + leaf, leaf) for leaf in group)
                continue
            if not isinstance(group, list):
                raise ValueError(f"neither list nor object in the tree: {type(group).__name__}")
            for entry in group:
                if isinstance(entry, dict):
                    waiting.append((start, entry))
                elif isinstance(entry, str):
                    out.append((start + entry, entry))
                else:
                    raise ValueError(f"leaf that is no string in the tree: {type(entry).__name__}")
    return out


def tree_leaves(tree: Column | str) -> Column:
    """``array<struct<path, leaf>>`` of a JSON text; null for a null one, and a malformed tree raises."""
    @F.arrow_udf("array<struct<path: string, leaf: string>>")
    def kernel(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"path": p, "leaf": leaf} for p, leaf in leaves_of(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("path", pa.string()), ("leaf", pa.string())])))

    return kernel(tree)
