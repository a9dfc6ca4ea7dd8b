"""Higher-dimensional graphs on Spark: simplicial complexes and directed incidence structures as two tables."""
