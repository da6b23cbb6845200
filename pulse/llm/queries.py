"""The queries of the subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from pulse.llm.contamination import OP7_SQL, op7_decontamination
from pulse.llm.languages import op1_language_id
from pulse.llm.maxent import op9_lm_scores
from pulse.llm.mixing import op5_source_mixing
from pulse.llm.neardup import op4_near_duplicates
from pulse.llm.packing import op11_retrieval_packing
from pulse.llm.pages import op2_html_extraction
from pulse.llm.periodic import op12_periodic_runs
from pulse.llm.repeats import op3_suffix_dedup
from pulse.llm.toolcalls import op8_tool_calls
from pulse.llm.topk import OP6_SQL, op6_topk_search
from pulse.llm.toxicity import op10_toxicity
from pulse.llm.turns import op13_conversation_repair


def pipeline(spark, sf_dir: str):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_source_mixing": op5_source_mixing,
    "op6_topk_search": op6_topk_search,
    "op7_decontamination": op7_decontamination,
    "op8_tool_calls": op8_tool_calls,
    "op9_lm_scores": op9_lm_scores,
    "op10_toxicity": op10_toxicity,
    "op11_retrieval_packing": op11_retrieval_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}
ORACLE = {"op6_topk_search": OP6_SQL, "op7_decontamination": OP7_SQL}
