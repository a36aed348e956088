import sys

from pyspark.sql import SparkSession

from strandline.cli import run

if __name__ == "__main__":
    run(SparkSession.builder.appName("strandline").getOrCreate(), sys.argv[1:])
