"""Question-template analytics as Spark DataFrame jobs.

Subpackages:
  functions  -- Column-level helpers (Python string semantics on Spark columns)
  sources    -- readers, writers, schema guards, HTML page extraction
  operators  -- DataFrame operators (coverage, frequency, BLEU, splits, chunking, generation)
  plans      -- end-to-end workflows and the registered query catalog
  streaming  -- the stateless stages applied to streaming DataFrames
"""

from qtemplates.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
