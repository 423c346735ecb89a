"""Registered queries. A module has QUERIES, name to function of session and data folder, and SQL, name to equal SQL."""

from cellweave.plans import candidates, lineage, problems, scoring, tracking

MODULES = [problems, candidates, lineage, tracking, scoring]
