"""premia: quote-price analytics on PySpark."""
