"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .decontamination import OP9_SQL, op9_decontamination
from .embedding_duplicates import op7_embedding_duplicates
from .language_id import op3_language_id
from .license_scan import op6_license_scan
from .near_duplicates import op5_near_duplicates
from .packing import op12_packing
from .quality import op2_quality
from .repeated_passages import op10_repeated_passages
from .secret_scan import op1_secret_scan
from .sentencepiece_bpe import op4_sentencepiece
from .toxicity import op8_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op9_decontamination": OP9_SQL,
    "op11_collocations": OP11_SQL,
}
