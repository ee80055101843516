"""churnforge: Spark-native tabular churn analytics.

Operators are generic over column names and run as DataFrame / SQL plans:
cleaning and feature expressions, leakage-safe encoders, fold assignment,
skew-safe running sums (exact AUC, average ranks), clustering features,
cross-fitted Spark ML models, drift checks, pseudo-labels and blending.
"""

from churnforge.spec import ColumnSpec

__all__ = ["ColumnSpec"]
__version__ = "0.1.0"
