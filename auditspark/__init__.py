"""auditspark: audits of large record archives, written as Spark DataFrame operators."""
