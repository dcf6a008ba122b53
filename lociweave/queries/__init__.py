"""Every registered query of the reference's own operators, and its SQL."""

from lociweave.queries import genotypes, model, records, sites, variants  # noqa: F401
from lociweave.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
