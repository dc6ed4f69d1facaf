"""Index a repository and write its graph as JSON: ``python -m graphloom PATH OUT``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .sources import repository


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    root, out = os.path.abspath(args[0]), args[1].rstrip("/")
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    owners = repository.owners_text(root)
    index = repository.Index(repository.files(spark, root), f"service:{os.path.basename(root)}", repository.module_name(root), owners)
    nodes, edges = index.nodes(), index.edges()
    for name, rows in (("nodes", nodes), ("edges", edges), ("violations", repository.violations(nodes, edges, owners))):
        rows.write.mode("overwrite").json(f"{out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
