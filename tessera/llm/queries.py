"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from tessera.llm.chat_format import OP9_SQL, op9_chat_format
from tessera.llm.collocations import OP13_SQL, op13_collocations
from tessera.llm.decontaminate import OP2_SQL, op2_decontaminate
from tessera.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from tessera.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from tessera.llm.flat_graph import OP12_SQL, op12_flat_graph
from tessera.llm.license_scan import OP10_SQL, op10_license_scan
from tessera.llm.line_dedup import OP3_SQL, op3_line_dedup
from tessera.llm.mixing import OP4_SQL, op4_mix_sources
from tessera.llm.ngram_join import OP1_SQL, op1_ngram_join
from tessera.llm.pii import op8_pii
from tessera.llm.quality import op6_quality
from tessera.llm.suffix_dedup import OP5_SQL, op5_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_line_dedup, op4_mix_sources, op5_suffix_dedup, op6_quality, op7_exact_dedup, op8_pii, op9_chat_format, op10_license_scan, op11_fill_in_middle, op12_flat_graph, op13_collocations)}
ORACLE_SQL = {"op1_ngram_join": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op9_chat_format": OP9_SQL, "op10_license_scan": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_flat_graph": OP12_SQL, "op13_collocations": OP13_SQL}
