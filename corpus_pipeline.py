"""The corpus pipeline: quality rules, SimHash near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the shared
folder and reread as the next one's ``docs``. All but the last return the columns of ``documents``. From the
mixing stage on, a row is a piece of a document and its id its place in the mixture, which packing keeps.
"""

from pyspark.sql import DataFrame, SparkSession

from grovelake.llm import mixing, packing, pii, quality, simhash
from grovelake.llm.store import written

STAGES = [
    ("quality", quality.stage),
    ("simhash", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained models, fingerprints and tokens can't be expressed in SQL; each stage's operator is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
