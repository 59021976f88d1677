"""Print the physical plan tree (explain formatted, tree part) of chosen queries.

usage: python tools/plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relaysync.plans import queries as Q  # noqa: E402
from relaysync.session import get_spark  # noqa: E402


def tree(df) -> str:
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    out = []
    for line in text.splitlines():
        if line.startswith("(1)"):
            break
        out.append(line)
    return "\n".join(out).strip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or ["all_requests", "redelivery_outcomes", "triples_after_delete"]
    spark = get_spark("local[8]", shuffle_partitions=16)
    for name in names:
        df = Q.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        print(f"### {name}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main()
