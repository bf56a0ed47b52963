"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from assay.llm import decontaminate, language, licenses, media, mixing, neardup, pseudo_likelihood, secrets, token_files, url_filter

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_language_id": language.op4_language_id,
    "op5_pseudo_likelihood": pseudo_likelihood.op5_pseudo_likelihood,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_token_files": token_files.op8_token_files,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_source_mixing": mixing.op10_source_mixing,
}
ORACLES = {
    "op6_license_scan": licenses.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
