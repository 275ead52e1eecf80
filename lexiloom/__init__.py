"""lexiloom: text-classification analytics and corpus preparation on Spark."""
