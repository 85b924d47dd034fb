"""Log normalisation and corpus preparation as Spark DataFrame operators."""
