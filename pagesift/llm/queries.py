"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .cascade import OP13_SQL, op13_quality_rules
from .decontaminate import OP8_SQL, op8_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .lexical import OP12_SQL, op12_lexical_search
from .piece_codec import op10_piece_codec
from .quality import op3_quality
from .sharding import op6_sharding
from .simhash import op1_simhash
from .spelling import op11_spelling
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity
from .warc import OP9_SQL, op9_warc
from .wrapper import OP2_SQL, op2_main_text

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_main_text": op2_main_text,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_piece_codec": op10_piece_codec,
    "op11_spelling": op11_spelling,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_main_text": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
