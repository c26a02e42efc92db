"""python -m threadloom COMMAND ..."""

import sys

from pyspark.sql import SparkSession

from .cli import run

if __name__ == "__main__":
    spark = SparkSession.builder.appName("threadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, sys.argv[1:]))
    spark.stop()
