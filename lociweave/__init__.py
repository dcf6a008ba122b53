"""Genotype imputation and admixture inference as Spark jobs."""
