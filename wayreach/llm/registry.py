"""The corpus operators' queries and the SQL that checks them."""

from .byte_bpe import op8_byte_bpe
from .digest import op9_fingerprints
from .embedding_dedup import op6_embedding_dedup
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .quality import op7_quality
from .simhash import op10_simhash
from .suffix_dedup import op1_suffix_dedup
from .token_files import op5_token_files
from .toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
}

ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op4_mixing": OP4_SQL,
}
