"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from attriscope.llm.op1_token_counts import op1_token_counts
from attriscope.llm.op2_cover_tree import op2_cover_tree
from attriscope.llm.op3_license_scan import OP3_SQL, op3_license_scan
from attriscope.llm.op4_language_id import op4_language_id
from attriscope.llm.op5_quality_rules import op5_quality_rules
from attriscope.llm.op6_sentencepiece import op6_sentencepiece
from attriscope.llm.op7_mixing import OP7_SQL, op7_mixing
from attriscope.llm.op8_html_extraction import op8_html_extraction
from attriscope.llm.op9_simhash import op9_simhash
from attriscope.llm.op10_quality_classifier import op10_quality_classifier
from attriscope.llm.op11_inverted_multi_index import OP11_SQL, op11_inverted_multi_index
from attriscope.llm.op12_orchard_clusters import OP12_SQL, op12_orchard_clusters
from attriscope.llm.op13_phrases import OP13_SQL, op13_phrases

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_cover_tree": op2_cover_tree,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash": op9_simhash,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_inverted_multi_index": op11_inverted_multi_index,
    "op12_orchard_clusters": op12_orchard_clusters,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {"op3_license_scan": OP3_SQL, "op7_mixing": OP7_SQL, "op11_inverted_multi_index": OP11_SQL, "op12_orchard_clusters": OP12_SQL,
          "op13_phrases": OP13_SQL}
