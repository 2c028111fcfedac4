"""Command line: ``python -m bundleloom [options] PACK``."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from bundleloom.options import parser, resolve
from bundleloom.plans.engine import PackEngine


def main(argv: list[str] | None = None) -> int:
    """0 when the pack was built; 1, with a message on stderr, when not."""
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(message)s")
    try:
        path, options = resolve(sys.argv[1:] if argv is None else argv)
        if path is None:
            parser().print_usage(sys.stderr)
            raise ValueError("an input directory or .zip file is needed")
        spark = SparkSession.builder.appName("bundleloom").getOrCreate()
        PackEngine(spark, path, options).write()
        return 0
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
