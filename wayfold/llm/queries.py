"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import ann, lang_id, line_dedup, media, minhash, mixing, pii, quality, repeats, resampling, runs, sp_codec, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_sentencepiece": sp_codec.op4_sentencepiece,
    "op5_minhash": minhash.op5_minhash,
    "op6_lang_id": lang_id.op6_lang_id,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality": quality.op8_quality,
    "op9_ann": ann.op9_ann,
    "op10_media": media.op10_media,
    "op11_repeats": repeats.op11_repeats,
    "op12_runs": runs.op12_runs,
    "op13_resampling": resampling.op13_resampling,
}
#: op9's SQL is brute force: equal where the forest has one leaf, as on tables of some hundred rows.
SQL = {"op1_line_dedup": line_dedup.SQL, "op5_minhash": minhash.SQL, "op9_ann": ann.SQL}
