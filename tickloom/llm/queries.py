"""Queries of this subpackage, and the SQL of those that SQL can express."""

from .embeddings import op8_embedding_near_dedup
from .lm import op10_lm_kneser_ney
from .mixing import OP5_SQL, op5_mix_fair_queue
from .packing import op2_pack_best_fit
from .pii import op6_pii_tagger
from .simhash import op4_simhash_near_dedup
from .substring import op7_substring_dedup
from .topk import OP9_SQL, op9_topk_multi_index
from .toxicity import op3_toxicity_machine
from .warc import OP1_SQL, op1_warc_fixity

QUERIES = {f.__name__: f for f in (op1_warc_fixity, op2_pack_best_fit, op3_toxicity_machine, op4_simhash_near_dedup, op5_mix_fair_queue, op6_pii_tagger, op7_substring_dedup, op8_embedding_near_dedup, op9_topk_multi_index, op10_lm_kneser_ney)}
SQL = {"op1_warc_fixity": OP1_SQL, "op5_mix_fair_queue": OP5_SQL, "op9_topk_multi_index": OP9_SQL}
