"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op11_divergence
from .jaccard import op13_jaccard
from .licenses import op3_licenses
from .licenses import oracle as licenses_sql
from .merkle import ORACLE as MERKLE_SQL
from .merkle import op12_merkle
from .mixing import op2_mixing
from .pii import op5_pii
from .quality import op7_quality
from .sharding import op4_sharding
from .simhash import op10_simhash
from .topk import ORACLE as TOPK_SQL
from .topk import op9_topk
from .toxicity import op1_toxicity
from .warc import ORACLE as WARC_SQL
from .warc import op6_warc

QUERIES = {"op1_toxicity": op1_toxicity, "op2_mixing": op2_mixing, "op3_licenses": op3_licenses, "op4_sharding": op4_sharding, "op5_pii": op5_pii, "op6_warc": op6_warc, "op7_quality": op7_quality, "op8_bpe": op8_bpe, "op9_topk": op9_topk, "op10_simhash": op10_simhash}
QUERIES |= {"op11_divergence": op11_divergence, "op12_merkle": op12_merkle, "op13_jaccard": op13_jaccard}

ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses_sql(), "op6_warc": WARC_SQL, "op9_topk": TOPK_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_merkle": MERKLE_SQL}
