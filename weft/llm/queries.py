"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from weft.llm.chat_format import OP8_SQL, op8_chat_format
from weft.llm.decontaminate import OP6_SQL, op6_decontaminate
from weft.llm.licenses import op7_licenses
from weft.llm.mixing import OP3_SQL, op3_mix_sources
from weft.llm.near_dedup import OP10_SQL, op10_near_dedup
from weft.llm.quality import OP1_SQL, op1_quality_rules
from weft.llm.secrets import op9_secret_scan
from weft.llm.toxicity import op4_toxicity
from weft.llm.url_filters import OP2_SQL, op2_url_filters
from weft.llm.warc_zip import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_mix_sources, op4_toxicity, op5_warc, op6_decontaminate, op7_licenses, op8_chat_format, op9_secret_scan, op10_near_dedup)}

#: Toxicity is learnt, licenses are aligned and secrets decoded: no SQL; tests hold them against brute force.
SQL = {"op1_quality_rules": OP1_SQL, "op2_url_filters": OP2_SQL, "op3_mix_sources": OP3_SQL, "op5_warc": OP5_SQL, "op6_decontaminate": OP6_SQL, "op8_chat_format": OP8_SQL, "op10_near_dedup": OP10_SQL}
