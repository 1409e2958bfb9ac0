"""loomwork: a Spark-native analytics engine for technical documents and test reports."""
