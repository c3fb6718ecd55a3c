"""Queries over trials again, with trials whose sides both range over all vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more_queries  # noqa: F401  registers its queries
from .queries import QUERIES, SCORED, SQL, WHOLE, WHOLE_SCORED

OVER_TRIALS = ("det_points", "min_dcf_sweep", "det_probit", "score_histogram", "equalized_weights", "avg_precision", "score_topk", "score_writer", "score_lines_five", "p_prune", "sinkhorn", "trial_recode")


def over_whole(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = WHOLE.set(True)
        try:
            return query(spark, sf_dir)
        finally:
            WHOLE.reset(token)

    return run


for _name in OVER_TRIALS:
    QUERIES[f"{_name}_whole"] = over_whole(QUERIES[_name])
    SQL[f"{_name}_whole"] = SQL[_name].replace(SCORED, WHOLE_SCORED)
