"""weftline: declarative data compilation and contracts on Spark."""
