"""lumenframe: a PySpark-native analytics library; every operator is a DataFrame or SQL plan."""
