"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from assayer.llm import langid, lm, media, neardup, packing, pieceencoder, quality, secrets, sharding, substrings


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            media.op1_chunked_media,
            packing.op2_variable_best_fit,
            secrets.op3_secret_automaton,
            langid.op4_piece_unigrams,
            sharding.op5_minimax_shards,
            lm.op6_attention_lm,
            quality.op7_rule_cascade,
            neardup.op8_bayes_neardup,
            substrings.op9_chunk_dedup,
            pieceencoder.op10_piece_viterbi,
        )
    }


def oracle_sql() -> dict:
    return {"op7_rule_cascade": quality.OP7_SQL, "op8_bayes_neardup": neardup.OP8_SQL}
