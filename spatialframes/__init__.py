"""Single-cell phenotyping analytics over multiplexed tissue imaging tables, on Spark."""

from spatialframes.functions.names import (
    list_supported,
    parse_patient_id,
    resolve_channels,
)
from spatialframes.operators.patches import fov_recipe
from spatialframes.operators.phenotype import predict
from spatialframes.operators.scoring import ABSTENTION_LABEL, iqr_abstain
from spatialframes.operators.signal import DEFAULT_CONFIG, apply_config, make_preprocessor

__all__ = [
    "ABSTENTION_LABEL",
    "DEFAULT_CONFIG",
    "apply_config",
    "fov_recipe",
    "iqr_abstain",
    "list_supported",
    "make_preprocessor",
    "parse_patient_id",
    "predict",
    "resolve_channels",
]
