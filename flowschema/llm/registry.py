"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from . import cover_tree, exact_dedup, licenses, mixing, packing, ppm, quality, sharding, simhash, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op6_licenses": licenses.op6_licenses,
    "op2_cover_tree": cover_tree.op2_cover_tree,
    "op3_urls": urls.op3_urls,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_ppm": ppm.op9_ppm,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op6_licenses": licenses.SQL,
    "op7_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}
