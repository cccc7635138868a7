"""Driver-side descriptions of what to measure: domains, cliques, workloads."""
