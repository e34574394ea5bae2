"""Multi-scale spatial analytics on PySpark DataFrames."""

from .operators.factorize import harmony_correct_counts, reduce_dimensions
from .operators.mapping import map_scales_to_distance
from .operators.preprocess import preprocess, qc_histograms
from .plans.multiscale import MultiscaleAnalysis
from .plans.subcluster import SubclusterAnalysis

__all__ = [
    "MultiscaleAnalysis",
    "SubclusterAnalysis",
    "harmony_correct_counts",
    "map_scales_to_distance",
    "preprocess",
    "qc_histograms",
    "reduce_dimensions",
]
