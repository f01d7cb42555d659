"""verilens: verification and language-mixing analytics as PySpark DataFrame operators."""
