"""textloom: a Spark-first engine for text attribution, review ledgers and training-data preparation."""

import os


def attach(spark) -> None:
    """Let Python workers of a session import this package from where the driver has it. On a cluster where that folder is not
    there, ship the package instead (spark.submit.pyFiles)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
