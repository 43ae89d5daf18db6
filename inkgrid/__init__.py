"""Print-raster preparation as Spark jobs: DataFrame in, DataFrame out."""
