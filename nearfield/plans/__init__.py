"""Relations that plan a study: workloads, implementations, feasibility, experiments."""
