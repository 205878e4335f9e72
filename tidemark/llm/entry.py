"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import SQL as DECONTAM_SQL
from .decontam import op11_decontamination
from .fim import SQL as FIM_SQL
from .fim import op13_fill_in_middle
from .language import op5_language
from .mainext import op8_main_text
from .neardup import op6_hyperminhash
from .packing import op2_packing
from .phrases import SQL as PHRASES_SQL
from .phrases import op12_collocations
from .pieces import op10_sentencepiece
from .quality import op1_quality
from .secrets import SQL as SECRETS_SQL
from .secrets import op3_secret_ledger
from .spotsigs import SQL as SPOTSIGS_SQL
from .spotsigs import op9_spotsigs
from .topk import SQL as TOPK_SQL
from .topk import op7_topk
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_hyperminhash": op6_hyperminhash,
    "op7_topk": op7_topk,
    "op8_main_text": op8_main_text,
    "op9_spotsigs": op9_spotsigs,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL: dict[str, str] = {"op3_secret_ledger": SECRETS_SQL, "op7_topk": TOPK_SQL, "op9_spotsigs": SPOTSIGS_SQL, "op11_decontamination": DECONTAM_SQL, "op12_collocations": PHRASES_SQL, "op13_fill_in_middle": FIM_SQL}
