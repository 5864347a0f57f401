"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from sparkprep.llm import archive, divergence, fingerprints, langid, line_dedup, mixing, packing, pitman_yor, quality, rope, simjoin, url_filter, vectors

QUERIES = {
    "op1_packing": packing.query,
    "op2_ngram_jaccard_join": simjoin.query,
    "op3_pitman_yor_scores": pitman_yor.query,
    "op4_fingerprints": fingerprints.query,
    "op5_quality": quality.query,
    "op6_language_id": langid.query,
    "op7_line_dedup": line_dedup.query,
    "op8_mix_sources": mixing.query,
    "op9_warc": archive.query,
    "op10_nearest_neighbours": vectors.query,
    "op11_url_filter": url_filter.query,
    "op12_source_divergence": divergence.query,
    "op13_fill_in_middle": rope.query,
}
ORACLE_SQL = {
    "op8_mix_sources": mixing.SQL,
    "op9_warc": archive.SQL,
    "op11_url_filter": url_filter.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_fill_in_middle": rope.SQL,
}
