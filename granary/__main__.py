"""``python -m granary SETTINGS.json OUT``: a whole retention run."""

from __future__ import annotations

import sys

from granary.config import RetentionConfig
from granary.plans.sweep import run
from granary.session import session


def main(args: list[str]) -> None:
    if len(args) != 2:
        raise SystemExit(__doc__)
    spark = session("granary")
    settings = "\n".join(r["value"] for r in spark.read.text(args[0], wholetext=True).collect())
    run(spark, RetentionConfig.load(settings), args[1]).orderBy("ratio", "node").show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
