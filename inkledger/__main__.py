"""python -m inkledger extract PATH | translate PATH: JSON lines on standard output.

Exit codes: 0 done, 1 failed, 2 translated but for some segments.
"""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("extract", "translate"):
        print(__doc__, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from inkledger import api
    from inkledger.operators.translate import Identity
    from inkledger.options import resolve

    spark = SparkSession.builder.appName("inkledger").getOrCreate()
    try:
        found = api.extract(spark, args[1])
        if args[0] == "extract":
            for row in found.summary().collect():
                print(json.dumps(row.asDict()))
            return 0
        done, report = api.translate_segments(api.segments(found.glyphs), Identity(), resolve())
        for row in done.toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return report.first().exit_code
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
