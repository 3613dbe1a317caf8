"""areascope: regional service-activity analytics on Spark DataFrames.

Subpackages:
  sources    -- feed scans, table readers and writers, test-table adapters
  functions  -- column expressions (text normalisation, safe ratios, labels)
  operators  -- DataFrame operators (cleaning, master, profile, features,
                trends, models, insights, outputs, reports)
  plans      -- end-to-end runs and the registered query catalogue
  streaming  -- incremental feed ingestion with Structured Streaming
"""

__version__ = "0.1.0"
