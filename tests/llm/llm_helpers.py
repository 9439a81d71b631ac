def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
