"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embeddings, language_model, lines, media, merkle, minhash, mixing, overwrite, pieces, substrings, topk, toxicity, urls

QUERIES = {
    "op1_language_model": language_model.op1_language_model,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lines": lines.op3_lines,
    "op4_minhash": minhash.op4_minhash,
    "op5_pieces": pieces.op5_pieces,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_substrings": substrings.op7_substrings,
    "op8_url_filter": urls.op8_url_filter,
    "op9_mixing": mixing.op9_mixing,
    "op10_media": media.op10_media,
    "op11_overwrite": overwrite.op11_overwrite,
    "op12_top_k": topk.op12_top_k,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op12_top_k": topk.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
