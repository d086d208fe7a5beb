"""All registered queries."""
from holdfast.plans import queries_a, queries_b, queries_c, queries_checks, queries_d, queries_e, queries_f, queries_frames, queries_g, queries_h, queries_i, queries_j, queries_k, queries_probes  # noqa: F401
from holdfast.plans.registry import ORACLES, QUERIES  # noqa: F401
