"""``spark-submit`` or ``python -m quern QUERY FOLDER [OUT]``: runs a query over a folder of tables.

Prints the first rows, or writes all of them to OUT as Parquet.  Without arguments, lists the queries.
"""

from __future__ import annotations

import sys

from quern.plans import catalogue
from quern.session import session


def main(args: list[str]) -> int:
    if len(args) < 2:
        print("\n".join(sorted(catalogue.queries())))
        return 0
    name, folder, *out = args
    found = catalogue.queries()[name](session(), folder)
    if out:
        found.write.mode("overwrite").parquet(out[0])
    else:
        found.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
