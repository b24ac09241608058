"""The numbered queries over the given tables, and their SQL twins where SQL can say it."""

from .codes import op12_codes
from .decontaminate import OP2_SQL, op2_decontaminate
from .html import op6_html
from .licenses import op7_licenses
from .packing import op3_best_fit_packing
from .pii import op10_pii
from .secrets import op9_secrets
from .sharding import op11_sharding
from .simhash import op1_simhash
from .topk import OP8_SQL, op8_topk
from .toxicity import op4_toxicity
from .warc import OP5_SQL, op5_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_html": op6_html,
    "op7_licenses": op7_licenses,
    "op8_topk": op8_topk,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
    "op11_sharding": op11_sharding,
    "op12_codes": op12_codes,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op8_topk": OP8_SQL,
}
