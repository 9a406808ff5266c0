"""Write PLANS.md: the final (after AQE) physical plan tree of each headline
query, run at the given scale.

    python scripts/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from pnlbook.plans.catalog import QUERIES  # noqa: E402
from pnlbook.session import get_spark  # noqa: E402


def tree(df) -> str:
    """The operator tree of the executed plan, without per-node details."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("+- == Initial Plan ==")[0]
    lines = []
    for line in text.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        lines.append(line if len(line) <= 160 else line[:157] + "...")
    return "\n".join(lines)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    out = ["# PLANS", "",
           f"Final physical plans (after AQE) of the headline queries, run on `{sf_dir}`",
           "with `local[8]`, 8 shuffle partitions. Made by `scripts/dump_plans.py`.", ""]
    for name in HEADLINE:
        if name.startswith("stream_"):
            continue
        out += [f"## {name}", "", "```", tree(QUERIES[name](spark, sf_dir)), "```", ""]
    spark.stop()
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
