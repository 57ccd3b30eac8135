"""Queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import divergence, hard_negatives, licenses, line_rules, mixing, packing, repeats, resharding, scaled_sketch, secrets, sentence_pieces, simhash, sql, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": line_rules.op1_line_frequency,
    "op7_simhash": simhash.op7_simhash,
    "op2_best_fit": packing.op2_best_fit,
    "op3_scaled_sketch": scaled_sketch.op3_scaled_sketch,
    "op4_factorization_machine": toxicity.op4_factorization_machine,
    "op5_bwt_merge": repeats.op5_bwt_merge,
    "op6_min_cost_flow": resharding.op6_min_cost_flow,
    "op8_sainte_lague": mixing.op8_sainte_lague,
    "op9_positional_index": licenses.op9_positional_index,
    "op10_token_efficiency": secrets.op10_token_efficiency,
    "op11_distance_keys": hard_negatives.op11_distance_keys,
    "op12_score_agenda": sentence_pieces.op12_score_agenda,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES: dict[str, str] = {"op1_line_frequency": sql.op1(), "op8_sainte_lague": sql.op8(), "op11_distance_keys": sql.op11(), "op13_divergence": sql.op13()}
