"""The Parquet key-set store and external databases."""
