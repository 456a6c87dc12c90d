"""Context selection and corpus analytics on Spark."""
