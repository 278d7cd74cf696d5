"""The queries of this subpackage by name, with the SQL that those are held against which SQL can express."""

from trellis.llm.alignment import op12_token_alignment
from trellis.llm.infilling import OP13_SQL, op13_fill_in_middle
from trellis.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from trellis.llm.licences import op11_licence_scan
from trellis.llm.lm import op6_lm_scoring
from trellis.llm.mixing import op5_source_mix
from trellis.llm.packing import op2_sequence_packing
from trellis.llm.pii import op8_pii
from trellis.llm.quality_model import op3_quality_model
from trellis.llm.rules import op10_quality_rules
from trellis.llm.secret_scan import op1_secret_scan
from trellis.llm.substrings import OP9_SQL, op9_substring_dedup
from trellis.llm.topk import OP7_SQL, op7_exact_topk

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_sequence_packing": op2_sequence_packing, "op3_quality_model": op3_quality_model, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_source_mix": op5_source_mix, "op6_lm_scoring": op6_lm_scoring, "op7_exact_topk": op7_exact_topk, "op8_pii": op8_pii, "op9_substring_dedup": op9_substring_dedup, "op10_quality_rules": op10_quality_rules, "op11_licence_scan": op11_licence_scan, "op12_token_alignment": op12_token_alignment, "op13_fill_in_middle": op13_fill_in_middle}
SQL = {"op4_ngram_jaccard": OP4_SQL, "op7_exact_topk": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
