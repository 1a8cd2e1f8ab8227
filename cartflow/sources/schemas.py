"""Explicit schemas of the basket tables (no inference pass over big files)."""

from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("eval_set", T.StringType(), False),
    T.StructField("order_number", T.IntegerType(), False),
])

ORDER_LINES = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("reordered", T.IntegerType(), False),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("aisle_id", T.IntegerType(), True),
    T.StructField("department_id", T.IntegerType(), True),
])

AISLES = T.StructType([
    T.StructField("aisle_id", T.IntegerType(), False),
    T.StructField("aisle", T.StringType(), True),
])

DEPARTMENTS = T.StructType([
    T.StructField("department_id", T.IntegerType(), False),
    T.StructField("department", T.StringType(), True),
])

SUBMISSION = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("products", T.StringType(), False),
])

# File name of each table in a basket data folder (CSV with header).
TABLE_FILES = {
    "orders": ("orders.csv", ORDERS),
    "prior_lines": ("order_products__prior.csv", ORDER_LINES),
    "train_lines": ("order_products__train.csv", ORDER_LINES),
    "products": ("products.csv", PRODUCTS),
    "aisles": ("aisles.csv", AISLES),
    "departments": ("departments.csv", DEPARTMENTS),
}
