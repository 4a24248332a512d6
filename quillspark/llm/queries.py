"""The registered queries of the training-data operators."""

from __future__ import annotations

from quillspark.llm.chat import OP10_SQL, op10_chat
from quillspark.llm.html_text import op3_html
from quillspark.llm.importance import OP13_SQL, op13_importance
from quillspark.llm.language_id import op6_language_id
from quillspark.llm.mixing import op5_mixing
from quillspark.llm.ngram_lm import op7_lm_scoring
from quillspark.llm.ogg import op9_ogg
from quillspark.llm.packing import op2_packing
from quillspark.llm.periodic_runs import op12_periodic_runs
from quillspark.llm.quality import op8_quality
from quillspark.llm.quality_gam import op11_quality_gam
from quillspark.llm.secret_scan import op1_secret_scans
from quillspark.llm.simhash import op4_simhash

OPERATORS = (
    op1_secret_scans,
    op2_packing,
    op3_html,
    op4_simhash,
    op5_mixing,
    op6_language_id,
    op7_lm_scoring,
    op8_quality,
    op9_ogg,
    op10_chat,
    op11_quality_gam,
    op12_periodic_runs,
    op13_importance,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLE_SQL: dict[str, str] = {"op10_chat": OP10_SQL, "op13_importance": OP13_SQL}
