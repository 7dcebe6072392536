"""Command line: python -m vesper.cli --mode f1 --data-dir data --output-dir outputs"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import modes


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vesper")
    parser.add_argument("--mode", default="f1", choices=modes.MODES)
    parser.add_argument("--data-dir", default="data")
    parser.add_argument("--output-dir", default="outputs")
    parser.add_argument("--install-check", action="store_true")
    got = parser.parse_args(args)
    if got.install_check:
        print(modes.install_check())
        return
    spark = SparkSession.builder.appName("vesper").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = modes.run(spark, got.data_dir, got.output_dir, got.mode)
    for name, df in out.items():
        print(name)
        df.show(3 if name.startswith("submission") else 25, truncate=False)
    if "strategy_scores" in out:
        print("best candidates of each target")
        modes.leaderboard(out["strategy_scores"]).show(25, truncate=False)


if __name__ == "__main__":
    main()
