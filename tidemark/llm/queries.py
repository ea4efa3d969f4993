"""The queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from tidemark.llm.clusters import OP11_SQL, op11_centroid_clusters
from tidemark.llm.decontaminate import OP9_SQL, op9_decontaminate
from tidemark.llm.html import op7_main_text
from tidemark.llm.infill import OP12_SQL, op12_fill_in_middle
from tidemark.llm.language import op13_language_id
from tidemark.llm.packing import op10_pack
from tidemark.llm.quality_model import op2_quality_model
from tidemark.llm.quality_rules import OP6_SQL, op6_quality_rules
from tidemark.llm.simhash import op5_simhash
from tidemark.llm.substrings import OP4_SQL, op4_substring_dedup
from tidemark.llm.tokens import op8_token_counts
from tidemark.llm.urls import OP1_SQL, op1_url_filter
from tidemark.llm.warc import op3_warc_fixity

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_model": op2_quality_model,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_main_text": op7_main_text,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_pack": op10_pack,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}
SQL = {
    "op1_url_filter": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
