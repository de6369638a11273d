"""Wide-table cleaning, labelling, profiling, modelling and rule validation on Spark."""

__version__ = "0.1.0"
