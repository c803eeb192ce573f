"""The training-data operators as queries: name to function of (session, folder)."""

from siltstone.llm import alignment, exact_dedup, langid, licenses, media, mixing, pii, quality, sentencepieces, simhash, spelling, suffixes, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_media": media.op4_media,
    "op5_langid": langid.op5_langid,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sentencepiece": sentencepieces.op7_sentencepiece,
    "op8_quality": quality.op8_quality,
    "op9_url_filter": urls.op9_url_filter,
    "op10_licenses": licenses.op10_licenses,
    "op11_spelling": spelling.op11_spelling,
    "op12_alignment": alignment.op12_alignment,
    "op13_suffix_dedup": suffixes.op13_suffix_dedup,
}

#: DuckDB SQL; operators without an entry are tested against brute force or held-out rows.
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_url_filter": urls.ORACLE_SQL,
    "op10_licenses": licenses.oracle_sql(),
}
