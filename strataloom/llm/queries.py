"""Registered queries of the training-data operators and the SQL that DuckDB can check them with."""

from strataloom.llm.decontam import op9_decontamination
from strataloom.llm.hilbert import op2_hilbert
from strataloom.llm.outliers import op3_outliers
from strataloom.llm.packing import op10_packing
from strataloom.llm.pii import op4_pii
from strataloom.llm.plm import op7_pseudo_likelihood
from strataloom.llm.quality import op1_quality
from strataloom.llm.roles import op5_roles
from strataloom.llm.simhash import op6_simhash
from strataloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_hilbert": op2_hilbert,
    "op3_outliers": op3_outliers,
    "op4_pii": op4_pii,
    "op5_roles": op5_roles,
    "op6_simhash": op6_simhash,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {}
