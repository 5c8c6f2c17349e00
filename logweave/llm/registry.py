"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding, quality_rules, secrets
from .bpe import op1_bpe
from .common import bounded
from .embedding import op5_embedding_dedup
from .packing import op4_packing
from .quality_classifier import op10_quality
from .quality_rules import op9_quality_rules
from .secrets import op8_secrets
from .sharding import op2_sharding
from .simhash import op6_simhash
from .token_files import op7_token_files
from .toxicity import op3_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_secrets": op8_secrets,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality": op10_quality,
}
QUERIES = {name: bounded(query) for name, query in QUERIES.items()}
#: Tokenizers, models, xxHash and binary searches are outside SQL; tests/llm has brute-force versions of those.
ORACLE_SQL: dict[str, str] = {"op5_embedding_dedup": embedding.SQL, "op8_secrets": secrets.SQL, "op9_quality_rules": quality_rules.SQL}
