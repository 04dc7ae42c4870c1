"""The tax-sale queries, built from operators and column expressions."""
