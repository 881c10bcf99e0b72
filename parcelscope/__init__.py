"""parcelscope: listing-market analytics as composable PySpark DataFrame operators."""
