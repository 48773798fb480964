"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from turnmill.llm.decontaminate import op1_decontaminate
from turnmill.llm.html_text import op10_html_text
from turnmill.llm.id_files import op11_id_files
from turnmill.llm.importance import op12_importance
from turnmill.llm.language import op3_language
from turnmill.llm.late_rows import op13_late_overwrite
from turnmill.llm.packing import op2_pack
from turnmill.llm.secrets import op8_secrets
from turnmill.llm.simhash import op9_simhash
from turnmill.llm.token_counts import op6_token_counts
from turnmill.llm.topk import OP7_SQL, op7_topk
from turnmill.llm.toxicity import op5_toxicity
from turnmill.llm.warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_language, op4_warc, op5_toxicity, op6_token_counts, op7_topk, op8_secrets, op9_simhash, op10_html_text, op11_id_files, op12_importance, op13_late_overwrite)}
SQL = {"op4_warc": OP4_SQL, "op7_topk": OP7_SQL}
