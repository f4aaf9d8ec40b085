"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from . import q_clustering, q_differential, q_labels, q_matching, q_niches, q_regions, q_reports, q_spatial

_FAMILIES = (q_spatial, q_niches, q_regions, q_differential, q_matching, q_clustering, q_labels, q_reports)

# Columns that DuckDB types as decimals (from literals) or longs where the engine has doubles or ints.
_TYPES = {
    "affine_apply": {"msi_x": "DOUBLE", "msi_y": "DOUBLE"},
    "backmap_scores": {"score": "DOUBLE"},
    "background_otsu": {"threshold": "DOUBLE"},
    **{f"binspect_{m}": {c: "DOUBLE" for c in ("n00", "n01", "n11")} for m in ("rank", "kmeans", "fisher")},
    "cell_type_contract": {"confidence": "DOUBLE"},
    "lipid_mapping": {"ppm_error": "DOUBLE"},
    "lmd_qc": {"net_area": "DOUBLE", "spacing": "DOUBLE"},
    "potts_energy": {"edge_term": "DOUBLE"},
    "ppm_candidates": {"candidate_rank": "INTEGER"},
    "projected_mask": {"x": "INTEGER"},
    "roi_score": {"coverage": "DOUBLE"},
    "shoelace_area": {"area": "DOUBLE"},
    "slide_area": {"area": "DOUBLE"},
}


def _typed(name: str, sql: str) -> str:
    if name not in _TYPES:
        return sql
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _TYPES[name].items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


QUERIES: dict = {name: f for family in _FAMILIES for name, f in family.Q.items()}
ORACLE_SQL: dict = {name: _typed(name, sql) for family in _FAMILIES for name, sql in family.SQL.items()}
