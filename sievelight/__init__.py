"""Mail-threat analytics and corpus engineering as PySpark DataFrame operators."""
