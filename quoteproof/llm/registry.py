"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from .op10_quality import op10_ordinal_quality
from .op11_alignment import op11_common_cut_alignment
from .op12_vector_codes import op12_yinyang_codes
from .op13_pages import op13_url_differencing
from .op1_fingerprints import op1_weighted_samples
from .op2_mixing import ORACLE as OP2
from .op2_mixing import op2_curriculum_mix
from .op3_pii import op3_disclosure_spans
from .op4_token_counts import op4_prefix_token_counts
from .op5_chat import ORACLE as OP5
from .op5_chat import op5_chat_round_trip
from .op6_jaccard_join import op6_partenum_join
from .op7_packing import op7_minimum_bin_slack
from .op8_token_records import op8_framed_records
from .op9_exact_dedup import ORACLE as OP9
from .op9_exact_dedup import op9_exact_dedup

QUERIES = {
    "op1_weighted_samples": op1_weighted_samples,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_disclosure_spans": op3_disclosure_spans,
    "op4_prefix_token_counts": op4_prefix_token_counts,
    "op5_chat_round_trip": op5_chat_round_trip,
    "op6_partenum_join": op6_partenum_join,
    "op7_minimum_bin_slack": op7_minimum_bin_slack,
    "op8_framed_records": op8_framed_records,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_common_cut_alignment": op11_common_cut_alignment,
    "op12_yinyang_codes": op12_yinyang_codes,
    "op13_url_differencing": op13_url_differencing,
}
ORACLES = {"op2_curriculum_mix": OP2, "op5_chat_round_trip": OP5, "op9_exact_dedup": OP9}
