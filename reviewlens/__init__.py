"""Opinion mining over product reviews, written as Spark DataFrame jobs."""
