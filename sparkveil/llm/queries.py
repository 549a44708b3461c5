"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_id import op6_language_id
from .licenses import op9_license_scan
from .mixing import OP3_SQL, op3_mixing
from .sentencepiece_stream import op10_sentencepiece
from .sharding import OP5_SQL, op5_sharding
from .simhash import op8_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_sharding": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
}
