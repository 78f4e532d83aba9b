"""``python -m tessera peek PATH [KIND ...]``: a summary of a dataset on disk, of either kind of store."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] != "peek":
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tessera.sources import chunked, store
    from tessera.sources.store import KINDS

    if bad := [k for k in args[2:] if k not in KINDS]:
        print(f"unknown kinds {bad}; known: {', '.join(KINDS)}", file=sys.stderr)
        return 2
    spark, path, kinds = SparkSession.builder.getOrCreate(), args[1], tuple(args[2:]) or None
    if store.exists(spark, f"{path.rstrip('/')}/dataset.json"):
        print(store.peek(spark, path, kinds))
    else:
        groups = kinds and tuple(g for g, k in chunked.GROUPS.items() if k in kinds)
        print(chunked.read(spark, path, groups, "warn").describe())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
