"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from querylens.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from querylens.llm.fingerprints import op3_fingerprints
from querylens.llm.language_model import op6_language_model
from querylens.llm.mixing import OP1_SQL, op1_mixing
from querylens.llm.near_dedup import op7_minhash
from querylens.llm.periodic_runs import op13_periodic_runs
from querylens.llm.phrases import op9_phrases
from querylens.llm.quality import op2_quality
from querylens.llm.quality_rules import OP11_SQL, op11_quality_rules
from querylens.llm.sentence_pieces import op5_sentencepiece
from querylens.llm.spelling import OP12_SQL, op12_spelling
from querylens.llm.substrings import op4_suffix_array
from querylens.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_array": op4_suffix_array,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language_model": op6_language_model,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_phrases": op9_phrases,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op1_mixing": OP1_SQL, "op10_exact_dedup": OP10_SQL, "op11_quality_rules": OP11_SQL, "op12_spelling": OP12_SQL}
