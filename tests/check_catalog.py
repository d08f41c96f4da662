"""Command line check: python tests/check_catalog.py SF_DIR [NAME ...]."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from oracle import compare, connect  # noqa: E402
from tenora.catalog import load  # noqa: E402
from tenora.session import build_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    catalog = load()
    for name in names or list(catalog):
        start = time.time()
        try:
            if catalog[name].sql:
                problem = compare(spark, con, catalog[name], sf_dir)
            else:
                print(f"     rows {catalog[name].build(spark, sf_dir).count()}")
                problem = None
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:300]}"
            if "SparkContext" in problem and "stopped" in str(e):
                raise
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(failed)} failed of {len(names or catalog)}: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
