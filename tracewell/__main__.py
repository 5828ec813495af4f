"""``python -m tracewell QUERY SF_DIR [ROWS]``: run a registered ledger query and show rows of it."""

from __future__ import annotations

import sys

from .plans.catalogue import QUERIES
from .session import session


def main() -> None:
    if len(sys.argv) < 3 or sys.argv[1] not in QUERIES:
        sys.exit(f"{__doc__}\nqueries: {', '.join(sorted(QUERIES))}")
    spark = session()
    QUERIES[sys.argv[1]](spark, sys.argv[2]).show(int(sys.argv[3]) if len(sys.argv) > 3 else 20, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
