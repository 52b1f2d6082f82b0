"""Named analyses (Q1-Q31): compositions of operators, parameterised by columns."""
