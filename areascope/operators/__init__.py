"""DataFrame operators. Each takes and returns DataFrames; none collects rows,
except bounded model parameters (forest nodes, cluster centres, per-partition
totals of the distributed rank)."""
