"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from .attention_lm import op2_language_model
from .decontamination import op5_decontamination
from .exact_kmeans import ORACLE as CLUSTER_SQL
from .exact_kmeans import op13_centroid_clusters
from .fill_in_middle import ORACLE as FILL_SQL
from .fill_in_middle import op11_fill_in_middle
from .fingerprints import op12_fingerprints
from .language_id import op4_language_id
from .line_dedup import op1_line_dedup
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op6_license_scan
from .sentencepiece_dropout import op7_sentencepiece
from .sharding import op10_sharding
from .vector_search import op3_vector_search
from .warc import ORACLE as WARC_SQL
from .warc import op8_warc
from .weighted_minhash import op9_near_duplicates

QUERIES: dict[str, Callable] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_model": op2_language_model,
    "op3_vector_search": op3_vector_search,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_fingerprints": op12_fingerprints,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLES: dict[str, str] = {"op6_license_scan": LICENSE_SQL, "op8_warc": WARC_SQL, "op11_fill_in_middle": FILL_SQL, "op13_centroid_clusters": CLUSTER_SQL}
