"""python -m partwise config.yaml"""

import sys

from pyspark.sql import SparkSession

from partwise.plans.config import load_config
from partwise.plans.pipeline import run

if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit("usage: python -m partwise config.yaml")
    result = run(SparkSession.builder.getOrCreate(), load_config(sys.argv[1]), write=True, progress=lambda p, m: print(f"{p} % {m}"))
    if result.comparison is not None:
        result.comparison.show(truncate=False)
