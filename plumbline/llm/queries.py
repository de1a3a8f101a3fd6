"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm.decontaminate import OP5_SQL, op5_decontaminate
from plumbline.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from plumbline.llm.jaccard import OP9_SQL, op9_ngram_jaccard
from plumbline.llm.language import op6_language
from plumbline.llm.line_dedup import OP4_SQL, op4_unit_dedup
from plumbline.llm.packing import op2_packing
from plumbline.llm.quality import op1_quality
from plumbline.llm.suffix_dedup import op10_suffix_dedup
from plumbline.llm.url_filter import OP3_SQL, op3_url_filter
from plumbline.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_unit_dedup": op4_unit_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_suffix_dedup": op10_suffix_dedup,
}
SQL = {"op3_url_filter": OP3_SQL, "op4_unit_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_ngram_jaccard": OP9_SQL}
