"""Queries of the training-data operators, and the DuckDB SQL of those that SQL
can express."""

from __future__ import annotations

from quire.llm import chat, decontaminate, host_rules, url_rules
from quire.llm.chat import op8_snapshot_collapse
from quire.llm.decontaminate import op2_positional_index
from quire.llm.host_rules import op12_host_rules
from quire.llm.iblt import op7_invertible_sketch
from quire.llm.langid import op10_language_id
from quire.llm.license_scan import op6_suffix_automaton
from quire.llm.mixing import op4_pareto_mixing
from quire.llm.neardup import op3_minhash_setsketch
from quire.llm.spelling import op11_spelling_variants
from quire.llm.suffix_dedup import op9_suffix_array
from quire.llm.token_align import op13_token_alignment
from quire.llm.token_count import op5_token_transducer
from quire.llm.url_rules import op1_redirect_equivalence

QUERIES = {
    f.__name__: f
    for f in (
        op1_redirect_equivalence,
        op2_positional_index,
        op3_minhash_setsketch,
        op4_pareto_mixing,
        op5_token_transducer,
        op6_suffix_automaton,
        op7_invertible_sketch,
        op8_snapshot_collapse,
        op9_suffix_array,
        op10_language_id,
        op11_spelling_variants,
        op12_host_rules,
        op13_token_alignment,
    )
}

ORACLE = {
    "op1_redirect_equivalence": url_rules.ORACLE,
    "op2_positional_index": decontaminate.ORACLE,
    "op8_snapshot_collapse": chat.ORACLE,
    "op12_host_rules": host_rules.ORACLE,
}
