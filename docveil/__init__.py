"""A PySpark engine for document privacy: detect, mask, pseudonymise, compare and inventory over DataFrames."""
