"""Cross-validation that chose the constants of touchline.llm.toxicity: only rows whose fold of 5 isn't 0 are looked at.

Run as ``python tests/llm/choose_toxicity.py FOLDER``; prints recall, false positives and AUC of each choice, over two inner folds."""

import itertools
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from touchline.llm import toxicity  # noqa: E402
from touchline.llm.base import stage, table  # noqa: E402


def rates(rows):
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / max(1, len(bad) * len(good))
    return len(bad), sum(x >= 0.5 for x in bad), len(good), sum(x >= 0.5 for x in good), round(auc, 4)


def main(folder):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    labels = table(spark, folder, "labels").where("toxic is not null").where(toxicity.fold(F.col("doc_id"), 5) != 0)
    docs = stage(table(spark, folder, "documents").join(labels.select("doc_id"), "doc_id", "left_semi"), "choose")
    inner = F.crc32(F.concat(F.lit("inner"), F.col("doc_id").cast("string")).cast("binary")) % 2
    for toxicity.PRIOR, toxicity.BOUND, toxicity.DRIFT in itertools.product((500.0,), (1.64, 2.5, 3.3), (-0.5,)):
        rows = []
        for part in (0, 1):
            model = toxicity.learn(docs, labels.where(inner != part))
            rows += toxicity.score(docs, model).select("doc_id", "score").join(labels.where(inner == part), "doc_id").select("score", "toxic").collect()
        print(folder, toxicity.PRIOR, toxicity.BOUND, toxicity.DRIFT, *rates(rows), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
