"""Scalar functions: regular-expression helpers, text cleaning, Arrow variants, SQL registration."""
