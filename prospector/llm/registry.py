"""The corpus queries by name, and their SQL where SQL can say them."""

from __future__ import annotations

from .chat import OP7_SQL, op7
from .decontaminate import OP4_SQL, op4
from .filter_audit import OP12_SQL, op12
from .hard_negatives import OP11_SQL, op11
from .licenses import op1
from .line_dedup import OP3_SQL, op3
from .near_vectors import OP9_SQL, op9
from .ngram_join import OP6_SQL, op6
from .packing import op8
from .quality import op5
from .secrets import op13
from .sharding import op10
from .warc import OP2_SQL, op2

QUERIES = {
    "op1_license_scan": op1,
    "op2_warc": op2,
    "op3_line_dedup": op3,
    "op4_benchmark_decontamination": op4,
    "op5_quality_classifier": op5,
    "op6_ngram_jaccard_join": op6,
    "op7_chat_formatting": op7,
    "op8_best_fit_packing": op8,
    "op9_embedding_near_dedup": op9,
    "op10_sharding": op10,
    "op11_hard_negatives": op11,
    "op12_filter_audit": op12,
    "op13_secret_scan": op13,
}

ORACLE_SQL = {"op2_warc": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op7_chat_formatting": OP7_SQL, "op9_embedding_near_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL}
