"""Registered queries of the corpus operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .ann_codes import op2_one_bit_search
from .html_text import op11_html_extraction
from .language_id import op4_language_id
from .license_scan import license_sql, op6_license_scan
from .merkle import manifest_sql, op13_merkle_manifest
from .ngram_join import op1_ngram_join
from .packing import op9_best_fit_packing
from .quality_rules import op7_quality_rules
from .quotes import op3_quotation_links
from .sentencepiece_codec import op5_sentencepiece
from .toxicity import op8_toxicity
from .url_filter import op10_url_filter

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_one_bit_search": op2_one_bit_search,
    "op3_quotation_links": op3_quotation_links,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
    "op11_html_extraction": op11_html_extraction,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {"op6_license_scan": license_sql(), "op13_merkle_manifest": manifest_sql()}
