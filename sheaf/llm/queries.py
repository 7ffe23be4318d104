"""Queries of the training-data operators, and SQL for those that SQL can express."""

from .ann import op6_nearest_neighbours
from .chat import op5_chat_formatting
from .embedding_dedup import op4_embedding_near_dedup
from .html_extract import op3_html_extraction
from .language import op9_language_id
from .minhash_dedup import op1_minhash_near_dedup
from .mixing import OP7_SQL, op7_mix_sources
from .packing import op10_best_fit_packing
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_suffix_dedup, op3_html_extraction, op4_embedding_near_dedup, op5_chat_formatting,
        op6_nearest_neighbours, op7_mix_sources, op8_toxicity, op9_language_id, op10_best_fit_packing,
    )
}
SQL = {"op7_mix_sources": OP7_SQL}
