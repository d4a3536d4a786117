"""The queries of this subpackage and their SQL."""

from . import alignment, html, language, minhash, mixing, packing, quality, resampling, scoring, suffix, tokenfile, urls, vectors

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_packing": packing.op2_packing,
    "op3_url_filter": urls.op3_url_filter,
    "op4_quality": quality.op4_quality,
    "op5_neighbours": vectors.op5_neighbours,
    "op6_html": html.op6_html,
    "op7_scoring": scoring.op7_scoring,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_language": language.op10_language,
    "op11_alignment": alignment.op11_alignment,
    "op12_resampling": resampling.op12_resampling,
    "op13_token_ids": tokenfile.op13_token_ids,
}
ORACLES = {"op4_quality": quality.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL}
