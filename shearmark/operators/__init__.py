"""Group-generic relational and statistical operators, DataFrame in and out."""
