"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import decontaminate, langid, merkle, multiindex, neardup, packing, pii, quality, secrets, spelling, toxicity, urls, warc

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_language_id": langid.op8_language_id,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_pii_pseudonyms": pii.op10_pii_pseudonyms,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_nearest_neighbours": multiindex.op12_nearest_neighbours,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {"op1_url_filter": urls.OP1_SQL, "op3_quality_rules": quality.OP3_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op11_merkle_manifest": merkle.OP11_SQL}
