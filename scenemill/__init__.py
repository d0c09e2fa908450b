"""scenemill: DataFrame operators for scenario mining, label evaluation and corpus work on Spark."""

__version__ = "0.1.0"
