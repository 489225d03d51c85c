"""Queries and SQL of this subpackage, by name."""

from quire.llm.classifier import op3_quality_classifier
from quire.llm.collocations import OP12_SQL, op12_collocations
from quire.llm.conversations import op13_conversation_repair
from quire.llm.html_text import OP11_SQL, op11_html_extraction
from quire.llm.line_dedup import OP5_SQL, op5_line_dedup
from quire.llm.media import op10_media
from quire.llm.mixing import OP4_SQL, op4_mixing
from quire.llm.packing import op8_packing
from quire.llm.pii import op6_pii
from quire.llm.quality_rules import OP7_SQL, op7_quality_rules
from quire.llm.sharding import op9_sharding
from quire.llm.simhash import op1_simhash
from quire.llm.tokens import op2_token_counts

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_media": op10_media,
    "op11_html_extraction": op11_html_extraction,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op4_mixing": OP4_SQL, "op5_line_dedup": OP5_SQL, "op7_quality_rules": OP7_SQL, "op11_html_extraction": OP11_SQL, "op12_collocations": OP12_SQL}
