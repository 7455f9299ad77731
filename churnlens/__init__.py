"""churnlens: customer-churn analytics and retention decisions on Spark.

Everything is a DataFrame transformation: validation, treatment, profiling,
splits, model metrics, and the expected-value campaign layer. See README.md.
"""

__version__ = "0.1.0"
