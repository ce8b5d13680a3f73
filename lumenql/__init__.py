"""LumenQL: a Spark-native SQL, DML and full-text engine with a MySQL-flavoured dialect."""
