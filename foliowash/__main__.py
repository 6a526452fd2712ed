"""python -m foliowash run IN OUT: cleans the images of a folder."""

from __future__ import annotations

import argparse

from foliowash import __version__
from foliowash.config import PRESETS


def main() -> None:
    p = argparse.ArgumentParser(prog="foliowash")
    p.add_argument("--version", action="version", version=__version__)
    run = p.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("source")
    run.add_argument("target")
    run.add_argument("--preset", choices=list(PRESETS))
    run.add_argument("--strict", action="store_true")
    a = p.parse_args()
    from pyspark.sql import SparkSession

    from foliowash import clean, preset
    from foliowash.sources.pages import read_images, write_cleaned

    spark = SparkSession.builder.appName("foliowash").getOrCreate()
    write_cleaned(clean(read_images(spark, a.source), preset(a.preset or "annot_only"), strict=a.strict), a.target)


if __name__ == "__main__":
    main()
