"""Company-disclosure analytics and corpus preparation on Spark DataFrames."""
